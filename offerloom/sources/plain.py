"""Small workbooks many at once: zip parts by their directory, and sheets of plain form (rows, cells, inline texts and numbers) by arrays.

What isn't of that form is told apart here and left to `xlsx`, which reads any.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOCAL, _ENTRY, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
_DAY = 33  # 1980-01-01, as zip counts days
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OPENING = f'<worksheet xmlns="{MAIN}"><sheetData>'.encode()
#: Bytes that XML can't hold, and the line end that its parsers replace.
_UNFIT = bytes({*range(32)} - {9, 10})
#: Empty rows and cells between others that one group may have.
MOST_GAPS = 1 << 20
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def zipped(parts: Iterable[tuple[bytes, bytes, bytes, int]], before: tuple[bytes, bytes, int] = (b"", b"", 0)) -> bytes:
    """A zip file of parts (name, content, content as it is stored, method), behind others that `entries` has made."""
    body, listed, n = entries(parts, before)
    return b"".join((body, listed, _END.pack(b"PK\5\6", 0, 0, n, n, len(listed), len(body), 0)))


def entries(parts: Iterable[tuple[bytes, bytes, bytes, int]], before: tuple[bytes, bytes, int] = (b"", b"", 0)) -> tuple[bytes, bytes, int]:
    """(parts as a zip file holds them, its directory of them, their number)."""
    held, listed, n = [before[0]], [before[1]], before[2]
    at = len(before[0])
    for name, content, stored, method in parts:
        about = (20, 0, method, 0, _DAY, zlib.crc32(content), len(stored), len(content), len(name), 0)
        held += [_LOCAL.pack(b"PK\3\4", *about), name, stored]
        listed += [_ENTRY.pack(b"PK\1\2", 20, *about, 0, 0, 0, 0, at), name]
        at += _LOCAL.size + len(name) + len(stored)
        n += 1
    return b"".join(held), b"".join(listed), n


def directory(data: bytes) -> dict[str, tuple[int, int, int, int, int]] | None:
    """(method, checksum, stored bytes, bytes, place) of a zip file's parts; None if it has anything beyond the plainest form."""
    if len(data) < _END.size:
        return None
    mark, disk, first, here, n, size, start, comment = _END.unpack_from(data, len(data) - _END.size)
    if mark != b"PK\5\6" or disk or first or here != n or comment or start + size + _END.size != len(data):
        return None
    out, at = {}, start
    for _ in range(n):
        if at + _ENTRY.size > start + size:
            return None
        mark, _, _, flags, method, _, _, crc, stored, whole, name, extra, note, disk, _, _, place = _ENTRY.unpack_from(data, at)
        if mark != b"PK\1\2" or flags & ~0x80E or method not in (0, 8) or disk or max(stored, whole, place) == 0xFFFFFFFF:
            return None
        try:
            key = data[at + _ENTRY.size : at + _ENTRY.size + name].decode("ascii")
        except UnicodeDecodeError:
            return None
        if key in out or place + _LOCAL.size > start:
            return None
        out[key] = method, crc, stored, whole, place
        at += _ENTRY.size + name + extra + note
    return out if at == start + size else None


def part(data: bytes, entry: tuple[int, int, int, int, int], name: str) -> bytes:
    """The content of a part; one that is damaged is an error, as the standard library's."""
    method, crc, stored, whole, place = entry
    head = _LOCAL.unpack_from(data, place)
    at = place + _LOCAL.size + head[9]
    if head[0] != b"PK\3\4" or data[place + _LOCAL.size : at] != name.encode():
        raise zipfile.BadZipFile(f"part {name} isn't where the directory says")
    raw = data[at + head[10] : at + head[10] + stored]
    try:
        content = zlib.decompressobj(-15).decompress(raw, whole + 1) if method else raw
    except zlib.error as e:
        raise zipfile.BadZipFile(f"part {name} is damaged") from e
    if len(content) != whole or zlib.crc32(content) != crc:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {name!r}")
    return content


# kinds of tags: what a sheet of plain form has, in the order in which they may follow each other
_BOOK, _DATA, _ROW, _TEXT_CELL, _CELL, _IS, _T, _T_END, _IS_END, _V, _V_END, _CELL_END, _ROW_END, _DATA_END, _BOOK_END = range(1, 16)
_NEXT = {
    _BOOK: (_DATA,),
    _DATA: (_ROW, _DATA_END),
    _ROW: (_TEXT_CELL, _CELL, _ROW_END),
    _TEXT_CELL: (_IS,),
    _CELL: (_V,),
    _IS: (_T,),
    _T: (_T_END,),
    _T_END: (_IS_END,),
    _IS_END: (_CELL_END,),
    _V: (_V_END,),
    _V_END: (_CELL_END,),
    _CELL_END: (_TEXT_CELL, _CELL, _ROW_END),
    _ROW_END: (_ROW, _DATA_END),
    _DATA_END: (_BOOK_END,),
    _BOOK_END: (_BOOK,),
}
_FOLLOWS = np.zeros((16, 16), bool)
for _a, _bs in _NEXT.items():
    _FOLLOWS[_a, list(_bs)] = True
_word = lambda s: int.from_bytes(s, "little")
#: Tags that are always written the same, by their first two letters; and how those begin that hold something.
_FIXED = {
    b"<is>": _IS, b"<t>": _T, b"</t>": _T_END, b"</is>": _IS_END, b"<v>": _V, b"</v>": _V_END, b"</c>": _CELL_END,
    b"</row>": _ROW_END, b"<sheetData>": _DATA, b"</sheetData>": _DATA_END, b"</worksheet>": _BOOK_END
}
_OPEN = {b'<row r="': _ROW, b'<c r="': _CELL, b"<workshe": _BOOK, b"<t xml:s": _T}
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

_KIND = np.zeros(1 << 16, np.int8)  # a tag's number among these, by two bytes
_SHAPES = [b"", *_FIXED, *_OPEN]
for _i, _tag in enumerate(_SHAPES[1:], 1):
    _KIND[_word(_tag[1:3])] = _i
_OF = np.array([0, *_FIXED.values(), *_OPEN.values()], np.int8)
_BEGIN = np.array([_word(x[:8]) for x in _SHAPES], np.uint64)
_BEGIN_MASK = _MASK[[min(len(x), 8) for x in _SHAPES]]
_LENGTH = np.array([0, *map(len, _FIXED), *(0 for _ in _OPEN)], np.int64)
#: The last eight bytes of the longer ones.
_LONG = [(i, np.uint64(_word(x[-8:]))) for i, x in enumerate(_SHAPES) if x in _FIXED and len(x) > 8]


def _digits(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the first k bytes of each word (0 to 7) are digits."""
    rest = (words ^ np.uint64(0x3030303030303030)) & _MASK[k]
    return ((rest | (rest + np.uint64(0x0606060606060606) & _MASK[k])) & np.uint64(0xF0F0F0F0F0F0F0F0)) == 0


def sheets(xmls: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, pa.Array] | None]:
    """(which sheets aren't of plain form, their rows if all are): of each row its sheet, its number from 0 and its cells.

    Rows that a sheet leaves out are empty, as cells are that a row leaves out.
    """
    odd = np.array([not (x.startswith(_OPENING) and x.count(b"<") == x.count(b">")) for x in xmls], bool)
    if odd.any() or not xmls:
        return odd, None
    joined = b"".join(xmls)
    everything = np.ones(len(xmls), bool)
    if len(joined.translate(None, _UNFIT)) != len(joined) or b"\xef\xbf\xbe" in joined or b"\xef\xbf\xbf" in joined:
        return everything, None
    try:
        joined.decode()
    except UnicodeDecodeError:
        return everything, None
    padded = bytes(32) + joined + bytes(32)
    data = np.frombuffer(padded, np.uint8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # eight bytes from each place on
    lt, gt = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
    of = np.searchsorted(np.cumsum([32, *map(len, xmls)])[1:], lt, "right")  # the sheet of each tag
    bad = gt < lt
    bad[:-1] |= gt[:-1] > lt[1:]
    # kinds
    first, length = words[lt], gt - lt + 1
    shape = _KIND[(first >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)]
    shape[((first & _BEGIN_MASK[shape]) != _BEGIN[shape]) | ((length != _LENGTH[shape]) & (_LENGTH[shape] > 0))] = 0
    for i, close in _LONG:
        at = np.flatnonzero(shape == i)
        shape[at[words[gt[at] - 7] != close]] = 0
    kind = _OF[shape]  # a sheet's first tag was compared whole
    row, cell, spaced = (np.flatnonzero(shape == _SHAPES.index(x)) for x in (b'<row r="', b'<c r="', b"<t xml:s"))
    at = lt[spaced]
    kind[spaced[(length[spaced] != 24) | (words[at + 8] != np.uint64(_word(b'pace="pr'))) | (words[at + 16] != np.uint64(_word(b'eserve">')))]] = 0
    # rows: a number and nothing else
    width = gt[row] - 1 - (lt[row] + 8)
    good = (width >= 1) & (width <= 7) & (data[gt[row] - 1] == 34) & _digits(words[lt[row] + 8], np.clip(width, 0, 7))
    kind[row[~good]] = 0
    # cells: a place, perhaps a style of one digit, perhaps that they hold a text
    end = gt[cell]
    text = (words[end - 15] == np.uint64(_word(b'" t="inl'))) & (words[end - 7] == np.uint64(_word(b'ineStr">')))
    quote = np.where(text, end - 15, end - 1)
    styled = (words[quote - 6] & _MASK[5] == np.uint64(_word(b'" s="'))) & (data[quote - 1] >= 48) & (data[quote - 1] <= 57)
    quote = np.where(styled, quote - 6, quote)
    start = lt[cell] + 6
    letters = [(data[start + i] >= 65) & (data[start + i] <= 90) for i in range(4)]
    many = np.where(letters[0], np.where(letters[1], np.where(letters[2], np.where(letters[3], 4, 3), 2), 1), 0)
    rest = quote - (start + many)
    good = (many >= 1) & (many <= 3) & (rest >= 1) & (rest <= 7) & (data[quote] == 34) & (data[end - 1] == 34) & _digits(words[start + many], np.clip(rest, 0, 7))
    kind[cell] = np.where(good, np.where(text, _TEXT_CELL, _CELL), 0)
    # order, and nothing but the cells' contents between tags
    holds = (kind == _T) | (kind == _V)
    bad |= kind == 0
    bad[:-1] |= ~_FOLLOWS[kind[:-1], kind[1:]] | (~holds[:-1] & (gt[:-1] + 1 != lt[1:]))
    bad |= (kind == _BOOK) != np.concatenate([[True], of[1:] != of[:-1]])
    bad[-1] |= kind[-1] != _BOOK_END
    if bad.any():
        odd[of[bad]] = True
        return odd, None

    # all are of plain form: numbers of rows and columns, texts
    is_row = kind == _ROW
    row, cell = np.flatnonzero(is_row), np.flatnonzero((kind == _TEXT_CELL) | (kind == _CELL))
    number = np.zeros(len(row), np.int64)
    width = gt[row] - 1 - (lt[row] + 8)
    for i in range(7):
        number = np.where(i < width, number * 10 + data[lt[row] + 8 + i] - 48, number)
    sheet, place = of[row], number - 1
    start = lt[cell] + 6
    column = np.zeros(len(cell), np.int64)
    for i in range(3):
        column = np.where(i < many, column * 26 + data[start + i] - 64, column)
    column -= 1
    owner = np.cumsum(is_row)[cell] - 1
    again = np.flatnonzero((owner[1:] == owner[:-1]) & (column[1:] <= column[:-1]))
    expected = np.concatenate([[0], np.where(sheet[1:] == sheet[:-1], place[:-1] + 1, 0)])[: len(row)]
    gaps = np.maximum(place - expected, 0)
    last = np.full(len(row), -1, np.int64)
    last[owner] = column
    if len(again) or (place < 0).any():
        odd[of[cell[again + 1]]] = True
        odd[sheet[place < 0]] = True
        return odd, None
    if gaps.sum() > MOST_GAPS or (last + 1).sum() > len(cell) + MOST_GAPS:
        return everything, None
    value = np.flatnonzero((kind == _T) | (kind == _V))
    spans = np.stack([gt[value] + 1, lt[value + 1]], 1)
    texts = pa.StringArray.from_buffers(
        2 * len(value),
        pa.py_buffer(np.append(spans.ravel(), spans[-1, 1] if len(value) else 0).astype(np.int32)), pa.py_buffer(padded)
    ).take(pa.array(np.arange(0, 2 * len(value), 2)))
    if b"&" in joined:
        coded = np.flatnonzero(pc.match_substring(texts, "&").to_numpy(zero_copy_only=False))
        plain, unknown = _decoded(texts.take(pa.array(coded)).to_pylist())
        if unknown:
            odd[of[cell[coded[unknown]]]] = True
            return odd, None
        mask = np.zeros(len(texts), bool)
        mask[coded] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(plain, pa.string()))
    empty = (spans[:, 0] == spans[:, 1]) & (kind[value] == _V)  # a number without digits is no value
    each = gaps + 1
    ends = np.cumsum(each)
    lengths = np.zeros(int(ends[-1]) if len(row) else 0, np.int64)
    lengths[ends - 1] = last + 1
    numbers = np.arange(len(lengths)) - np.repeat(ends - each, each) + np.repeat(place - gaps, each)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    which = np.full(int(offsets[-1]), -1, np.int64)
    which[offsets[ends[owner] - 1] + column] = np.where(empty, -1, np.arange(len(cell)))
    cells = texts.take(pa.array(which, mask=which < 0))
    return odd, (np.repeat(sheet, each), numbers, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells))


def _decoded(texts: list[str]) -> tuple[list[str], list[int]]:
    """Texts with XML's five entities read, and which have others."""
    known: dict[str, str | None] = {}
    for text in texts:
        if text not in known:
            fine = len(re.findall("&(?:amp|lt|gt|quot|apos);", text)) == text.count("&")
            known[text] = re.sub("&([a-z]+);", lambda m: _ENTITIES[m[1]], text) if fine else None
    return [known[x] or "" for x in texts], [i for i, x in enumerate(texts) if known[x] is None]
