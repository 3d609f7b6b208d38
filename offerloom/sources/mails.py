"""The readable part of a mail: a tree of parts, transfer encodings and character sets."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_string
from email.message import Message

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .files import strip_html

# Headers by which a text is taken for a mail, among its first characters; marks of HTML in a body that doesn't
# say what it is.
MAIL_HEADERS, HEADER_CHARS = ("from", "to", "subject", "content-type", "mime-version"), 2000
HTML_MARKS = ("<html", "<body", "<div")


def _leaves(part: Message) -> Iterator[Message]:
    """The parts that hold something, in order, whatever multiparts they are nested in; attached files are none."""
    if part.is_multipart():
        for inner in part.get_payload():
            yield from _leaves(inner)
    elif part.get_content_disposition() != "attachment":
        yield part


def _said(part: Message) -> str:
    """A part's text: quoted-printable and base64 are decoded from its character set; an unknown one is taken for UTF-8."""
    if part.get("content-transfer-encoding", "").strip().lower() not in ("base64", "quoted-printable"):
        return part.get_payload()
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def readable(raw: str) -> tuple[str, bool]:
    """(text, whether it is HTML) of a mail with headers."""
    mail = message_from_string(raw)
    leaves = list(_leaves(mail)) if mail.keys() else []
    for kind in ("text/plain", "text/html") if mail.is_multipart() else ():
        for part in leaves:
            if part.get_content_type() == kind:
                return _said(part), kind == "text/html"
    # no part to choose from: what follows the headers
    body = _said(mail) if mail.keys() and not mail.is_multipart() else raw.replace("\r\n", "\n").partition("\n\n")[2] or raw
    return body, any(mark in body.lower() for mark in HTML_MARKS)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("html", BooleanType())]))
def _readable(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else readable(x) for x in raw], columns=["text", "html"])


def mail_text(c: Column) -> Column:
    """The readable part of a mail: of several parts the first plain text, else the first HTML as text; else what follows the
    headers. Lines end with a line feed.

    Texts without mail headers are taken as they are, and so are empty ones; null is null. Only mails leave the JVM.
    """
    mail = F.substring(c, 1, HEADER_CHARS).rlike(rf"(?im)^({'|'.join(MAIL_HEADERS)}):")
    part = _readable(F.when(mail, c))
    text = F.replace(part["text"], F.lit("\r\n"), F.lit("\n"))
    return F.when(~mail, c).otherwise(F.when(part["html"], strip_html(text)).otherwise(text))
