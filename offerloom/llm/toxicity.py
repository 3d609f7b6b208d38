r"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled rows: words and word beginnings whose share of toxic documents
can't be chance. Its trie is intersected with the Levenshtein automata of its terms (one edit, or
two for long terms; a swap of neighbours is one edit) and made deterministic as words come; a
task walks all distinct words of a slice through it at once. A hit is weighed by the window of
words around it: quotation marks around it or words of reporting near it speak for a quotation.
Spellings close to a term that also occur in clean labelled rows are not hits. A logistic model of three
figures for each document gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, column, map_rows, short_batches, slices, stored
from .words import ALNUM_LOWER, Words, words

#: At most so many labelled rows are learned from (chosen by hash).
SAMPLE = 40_000
#: Lengths of word beginnings that may be terms.
STEMS = range(3, 9)
#: Terms of at least so many letters are also found with one edit, with two.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words before and after a hit that are its context.
WINDOW = 8
# Words that report speech, in the languages of the test data.
REPORTING = frozenset(
    "said says say quote quoted quotes called calls wrote writes word words term sagte sagt schrieb nannte wort dit disait écrit mot dijo dice escribió palabra".split()
)
OPENING, CLOSING = "“„«‹", "”“»›"


class Automaton:
    """The deterministic intersection, built as far as it is walked.

    A state is a set of (trie node, edits, letter owed by a swap); the least edits for each. State 0 is
    dead, state 1 the start.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for table, marks in ((terms, self.term), (stems, self.stem)):
            for t in table:
                node = 0
                for c in t:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                        self.stem.append(None)
                    node = self.children[node][c]
                marks[node] = t
        self.edits = [0] * len(self.children)  # that some term below the node allows
        for t in terms:
            node, allowed = 0, self.allowed(t)
            self.edits[0] = max(self.edits[0], allowed)
            for c in t:
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], allowed)
        letters = sorted({c for t in (*terms, *stems) for c in t})
        self.letters = letters
        self.codes = np.array([ord(c) for c in letters], np.int64)
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.table = np.full((1, len(letters) + 1), 0, np.int32)
        self.accepts: list[tuple[str, int] | None] = [None]
        self.start = self._state({(0, 0, ""): 0})

    @staticmethod
    def allowed(term: str) -> int:
        return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0

    def _state(self, seeds: dict) -> int:
        least: dict[tuple, int] = {}
        work = [(n, e, owed) for n, e, owed in seeds]
        while work:
            n, e, owed = work.pop()
            if e > self.edits[n] and e > 0 or least.get((n, owed), 9) <= e:
                continue
            least[n, owed] = e
            if not owed:
                work += [(child, e + 1, "") for child in self.children[n].values()]  # a letter left out
        key = frozenset((n, e, owed) for (n, owed), e in least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            best = None
            for n, e, owed in key:
                for t, exact in ((self.stem[n], True), (self.term[n], False)):
                    if t and not owed and (e == 0 if exact else e <= self.allowed(t)) and (best is None or (e, t) < best):
                        best = (e, t)
            self.accepts.append(best and (best[1], best[0]))
            if len(self.sets) > len(self.table):
                self.table = np.concatenate([self.table, np.full((max(256, len(self.table)), self.table.shape[1]), -1, np.int32)])
        return self.states[key]

    def _step(self, state: int, letter: int) -> int:
        c = self.letters[letter] if letter < len(self.letters) else None
        seeds = {}
        for n, e, owed in self.sets[state]:
            if owed:
                if c == owed:
                    seeds[n, e, ""] = 0
                continue
            if self.stem[n] and e == 0:
                seeds[n, 0, ""] = 0
            if c in self.children[n]:
                seeds[self.children[n][c], e, ""] = 0
            if self.edits[n] > e:
                seeds[n, e + 1, ""] = 0  # a letter too many
                for x, child in self.children[n].items():
                    seeds[child, e + 1, ""] = 0  # another letter
                    if c is not None and x != c and c in self.children[child]:
                        seeds[self.children[child][c], e + 1, x] = 0  # a swap: x is to come
        return self._state(seeds) if seeds else 0

    def walk(self, strings: list[str]) -> np.ndarray:
        """The state behind each string."""
        lengths = np.array([len(s) for s in strings], np.int64)
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = np.searchsorted(self.codes, codes)
        known = letter < len(self.codes)
        known[known] = self.codes[letter[known]] == codes[known]
        letter = np.where(known, letter, len(self.codes))
        first = np.cumsum(lengths) - lengths
        state = np.full(len(strings), self.start, np.int64)
        active = np.arange(len(strings))
        at = 0
        while len(active := active[(lengths[active] > at) & (state[active] != 0)]):
            s, x = state[active], letter[first[active] + at]
            following = self.table[s, x]
            if (missing := following < 0).any():
                for a, b in {*zip(s[missing].tolist(), x[missing].tolist())}:
                    target = self._step(a, b)
                    self.table[a, b] = target
                following = self.table[s, x]
            state[active] = following
            at += 1
        return state


@dataclass
class Model:
    """terms, stems: log ratios of the lexicon's rates. benign: close spellings that clean rows hold. close: the weight of
    another one. weights: of 1 and the three figures.
    """

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    benign: frozenset[str] = frozenset()
    close: float = 0.0
    weights: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)


class Finder:
    """Hits of a model in slices of texts; what is known of a word is kept, up to a bound."""

    MOST_KNOWN = 1_000_000

    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.terms, model.stems)
        self.known = np.zeros(0, np.uint64)
        self.hits: dict[int, tuple[str, int, str]] = {}

    def find(self, found: Words) -> list[tuple[int, str, int, str]]:
        """(word number, term, edits, spelling) in order."""
        hashes = found.hashes()
        if not len(hashes) or not (self.model.terms or self.model.stems):
            return []
        distinct, at = np.unique(hashes, return_index=True)
        new = ~np.isin(distinct, self.known, assume_unique=True)
        at, fresh_hashes = at[new], distinct[new]
        if len(at):
            raw = found.buf.tobytes()
            spelled = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(found.start[at].tolist(), found.end[at].tolist())]
            states = self.automaton.walk(spelled)
            for i in np.flatnonzero(states):
                accepted = self.automaton.accepts[states[i]]
                if accepted and not (accepted[1] and spelled[i] in self.model.benign):
                    self.hits[int(fresh_hashes[i])] = (*accepted, spelled[i])
            self.known = np.union1d(self.known, fresh_hashes) if len(self.known) < self.MOST_KNOWN else np.sort(
                np.concatenate([fresh_hashes, np.fromiter(self.hits, np.uint64, len(self.hits))])
            )
            self.known = np.unique(self.known)
        flagged = np.isin(hashes, np.fromiter(self.hits, np.uint64, len(self.hits))) if self.hits else np.zeros(len(hashes), bool)
        return [(int(i), *self.hits[int(hashes[i])]) for i in np.flatnonzero(flagged)]


def quotation(before: str, after: str) -> float:
    """How much a context speaks for a quotation: 0, 0.5 (words of reporting) or 0.8 (a quotation opens before and closes after)."""
    straight = before.count('"') % 2 == 1 and '"' in after
    opened = max((before.rfind(c) for c in OPENING), default=-1) > max((before.rfind(c) for c in "”»›"), default=-1)
    if straight or (opened and any(c in CLOSING for c in after)):
        return 0.8
    return 0.5 if REPORTING & {*before.lower().split(), *after.lower().split()} else 0.0


def sums(texts: pa.Array, finder: Finder) -> tuple[np.ndarray, list[list[dict]]]:
    """For each text: the weights of its hits, of what is quoted of them, and of its hits in 100 words; and its hits."""
    out = np.zeros((len(texts), 3))
    hits: list[list[dict]] = [[] for _ in range(len(texts))]
    model = finder.model
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        found = words(part, ALNUM_LOWER)
        got = finder.find(found)
        if not got:
            continue
        data = b"".join(t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part)
        for i, term, edits, spelling in got:
            doc = int(found.doc[i])
            first, last = int(found.first[doc]), int(found.first[doc + 1]) - 1
            a, b = found.start[max(first, i - WINDOW)], found.end[min(last, i + WINDOW)]
            # marks directly before the window's first word or behind its last belong to it
            before = data[
                max(a - 1, found.start[first] - 1 if i - WINDOW < first else a - 1, 0) : found.start[i]
            ].decode("utf-8", "replace")
            after = data[found.end[i] : b + 3].decode("utf-8", "replace")
            w = model.close if edits else model.stems[term] if term in model.stems and term not in model.terms else model.terms[term]
            q = quotation(before, after)
            out[lo + doc] += w * (1 - q), w * q, w * (1 - q) * 100 / max(100, last + 1 - first)
            hits[lo + doc].append({"word": i - first, "spelling": spelling, "term": term, "edits": edits, "quotation": q})
    return out, hits


def probability(features: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    x = np.concatenate([np.ones((len(features), 1)), np.log1p(features)], 1)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -35, 35)))


def _logistic(features: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton's method with a ridge on all but the constant."""
    x = np.concatenate([np.ones((len(features), 1)), np.log1p(features)], 1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge * max(1, len(y)) ** 0.5 / 10] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _terms(text: str) -> dict[tuple[str, bool], int]:
    """(term, is a beginning) of a text, its words and their beginnings, and how often each stands there."""
    found = words(pa.array([text]), ALNUM_LOWER)
    raw = found.buf.tobytes()
    times: dict[bytes, int] = {}
    for a, b in zip(found.start.tolist(), found.end.tolist()):
        times[raw[a:b]] = times.get(raw[a:b], 0) + 1
    out: dict[tuple[str, bool], int] = {}
    for word, n in times.items():
        word = word.decode("utf-8", "replace").lower()
        out[word, False] = out.get((word, False), 0) + n
        for size in STEMS:
            if len(word) <= size:
                break
            key = (word[:size], True)
            out[key] = out.get(key, 0) + n
    return out


def _counted(sample: DataFrame, which: frozenset | None) -> DataFrame:
    """In how many documents each term stands, and how often; counts are added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]):
        docs: dict[tuple[str, bool], int] = {}
        twice: dict[tuple[str, bool], int] = {}
        often: dict[tuple[str, bool], int] = {}
        times: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                for t, n in _terms(text or "").items():
                    if which is None or t in which:
                        docs[t] = docs.get(t, 0) + 1
                        twice[t] = twice.get(t, 0) + (n > 1)
                        often[t] = often.get(t, 0) + min(n, 4)
                        times[t] = times.get(t, 0) + n
                if len(docs) > 500_000:
                    yield from ((*t, n, twice[t], often[t], times[t]) for t, n in docs.items())
                    docs, twice, often, times = {}, {}, {}, {}
        yield from ((*t, n, twice[t], often[t], times[t]) for t, n in docs.items())

    return map_rows(
        sample,
        count,
        "term string, stem boolean, n long, twice long, often long, times long"
    ).groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("n", "twice", "often", "times")))


def _settings(sample: DataFrame, which: frozenset) -> DataFrame:
    """In how many settings each term stands: the words next to its first place in each document. Copies share theirs."""

    def settings(batches: Iterator[pa.RecordBatch]):
        seen = set()
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                found = words(pa.array([text]), ALNUM_LOWER)
                raw = found.buf.tobytes()
                spelled = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(found.start.tolist(), found.end.tolist())]
                done = set()
                for i, word in enumerate(spelled):
                    for t in ((word, False), *((word[:n], True) for n in STEMS if n < len(word))):
                        if t in which and t not in done:
                            done.add(t)
                            seen.add((*t, " ".join(spelled[max(i - 1, 0) : i] + ["_"] + spelled[i + 1 : i + 2])))
        yield from seen

    return map_rows(
        sample,
        settings,
        "term string, stem boolean, setting string"
    ).groupBy("term", "stem").agg(F.countDistinct("setting").alias("n"))


def _surprise(n1: int, n0: int, base: float) -> float:
    """n times the divergence of the toxic share from the base rate, if it is above."""
    n, p = n1 + n0, n1 / (n1 + n0)
    if p <= base:
        return 0.0
    return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0))


#: Counts of a term in the toxic or the clean rows: (term, is a beginning) -> (documents, documents that hold it twice or more,
#: times but at most 4 a document, times).
Counts = dict[tuple[str, bool], tuple[int, int, int, int]]


def eligible(
    toxic: Counts, clean: Counts, n1: int, n0: int, settings: dict[tuple[str, bool], int] | None = None,
    chance: float = 0.05, least_share: float = 0.35
) -> set[tuple[str, bool]]:
    """Terms that are toxic beyond chance, given how many were looked at: in documents that hold them, or hold them twice.
    settings: no more than so many documents of each count.
    """
    base = n1 / (n1 + n0)
    need = math.log(2 * max(len(toxic), 1) / chance)
    out = set()
    for t, (a, twice1, _, _) in toxic.items():
        b, twice0, _, _ = clean.get(t, (0, 0, 0, 0))
        most = a if settings is None else settings.get(t, 0)
        for x, y in ((min(a, most), b), (min(twice1, most), twice0)):
            if x + y and x / (x + y) >= least_share and _surprise(x, y, base) >= need:
                out.add(t)
    return out


def choose_terms(
    good: set[tuple[str, bool]], toxic: Counts, clean: Counts, n1: int, n0: int, words1: int, words0: int,
    least_weight: float = 2.0
) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with the log ratio of their rates, if it is at least least_weight.

    Of terms that begin with one another, the most surprising is taken; of equals a word before a beginning,
    and the longer beginning.
    """
    base = n1 / (n1 + n0)
    ranked = []
    for t, stem in good:
        (_, _, often1, times1), (_, _, often0, times0) = toxic[t, stem], clean.get((t, stem), (0, 0, 0, 0))
        w = math.log((times1 + 0.5) / (words1 + 1)) - math.log((times0 + 0.5) / (words0 + 1))
        ranked.append((-_surprise(often1, often0, base), stem, -len(t), t, w))
    terms: dict[str, float] = {}
    stems: dict[str, float] = {}
    beginnings: set[str] = set()
    for _, stem, _, t, w in sorted(ranked):
        own = [t[:n] for n in range(1, len(t) + 1)]
        if w < least_weight or any(x in stems for x in own) or (stem and (t in beginnings or any(x in terms for x in own))):
            continue
        (stems if stem else terms)[t] = w
        beginnings.update(own)
    return terms, stems


def learn(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE
) -> Model:
    """A model from labelled rows: at most `sample` of them, by the hash of their ids. Labels other than 0 and 1 and null ids are left out.

    Without labelled rows of both kinds, the model gives every text the same low score.
    """
    marked = labels.where(
        F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)
    ).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3)) == 0)
    texts = short_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample is bounded, so one side of this join is
    rows = stored(texts.join(F.broadcast(marked), "id").select("text", "y", "fold"), "labelled")
    counts = {
        r["y"]: (r["n"], r["words"] or 0) for r in rows.groupBy("y").agg(
            F.count("*").alias("n"),
            F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("words")
        ).collect()
    }
    if len(counts) < 2:
        return Model()
    (n0, words0), (n1, words1) = counts[0], counts[1]

    def collected(found: DataFrame) -> Counts:  # bounded, as the sample is
        return {(r["term"], r["stem"]): (r["n"], r["twice"], r["often"], r["times"]) for r in found.collect()}

    toxic = collected(_counted(rows.where("y = 1"), None).where(F.col("n") >= 4))
    clean = collected(_counted(rows.where("y = 0"), frozenset(toxic)))
    good = frozenset(eligible(toxic, clean, n1, n0))
    settings = {(r["term"], r["stem"]): r["n"] for r in _settings(rows.where("y = 1"), good).collect()}
    good = eligible(toxic, clean, n1, n0, settings)
    terms, stems = choose_terms(good, toxic, clean, n1, n0, words1, words0)
    model = Model(terms, stems)

    def close(batches: Iterator[pa.RecordBatch]):
        finder = Finder(model)
        for batch in batches:
            for lo, hi in slices(column(batch, "text")):
                finder.find(words(column(batch, "text")[lo:hi], ALNUM_LOWER))
        yield from ((s,) for _, edits, s in finder.hits.values() if edits)

    def spellings(clean_rows: DataFrame) -> frozenset[str]:  # bounded: what the automaton accepts
        return frozenset(r["s"] for r in map_rows(clean_rows, close, "s string").distinct().collect())

    # the weights are fitted where the benign spellings were not learned
    apart = spellings(rows.where("y = 0 and not fold"))
    model.benign, benign = apart, apart | spellings(rows.where("y = 0 and fold"))
    # misspelt terms are taken to be a tenth as frequent in toxic rows as the terms; how frequent close spellings are in clean
    # rows is counted
    def close_ones(batches: Iterator[pa.RecordBatch]):
        finder = Finder(model)
        for batch in batches:
            for lo, hi in slices(column(batch, "text")):
                found = words(column(batch, "text")[lo:hi], ALNUM_LOWER)
                yield len(found.start), sum(edits > 0 for _, _, edits, _ in finder.find(found))

    n_words, n_close = map_rows(rows.where("y = 0 and fold"), close_ones, "words long, close long").agg(
        F.coalesce(F.sum("words"), F.lit(0)),
        F.coalesce(F.sum("close"), F.lit(0))
    ).head()
    times = sum(toxic[t, False][3] for t in terms if Automaton.allowed(t))
    model.close = max(0.0, math.log((0.1 * times + 0.5) / (words1 + 1)) - math.log((n_close + 0.5) / (n_words + 1)))

    def measured(batches: Iterator[pa.RecordBatch]):
        finder = Finder(model)
        for batch in batches:
            features, _ = sums(column(batch, "text"), finder)
            yield from zip(column(batch, "y").to_pylist(), *features.T.tolist())

    found = map_rows(rows.where("fold"), measured, "y int, a double, b double, c double").toArrow()
    y = np.asarray(found["y"], float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = _logistic(np.stack([np.asarray(found[c]) for c in "abc"], 1), y)
    else:
        model.weights = (-4.0, 2.0, 0.0, 1.0)
    model.benign = benign
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= 0.5) and hits (array of word, spelling, term, edits, quotation).

    Null and empty texts score as a text without hits. Nothing but the text is looked at. Columns of the new names are
    replaced, others pass through; an empty table gives an empty table.
    """
    docs = short_batches(docs).drop("score", "predicted", "hits")
    hit = T.ArrayType(T.StructType.fromDDL("word int, spelling string, term string, edits int, quotation double"))
    out = T.StructType(
        [
            *docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
            T.StructField("hits", hit)
        ]
    )
    schema = arrow_schema(out)

    def scored(batches: Iterator[pa.RecordBatch]):
        finder = Finder(model)
        for batch in batches:
            features, hits = sums(column(batch, text_col), finder)
            p = probability(features, model.weights)
            new = {
                "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32)),
                "hits": pa.array(hits, schema.field("hits").type)
            }
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else column(batch, f.name) for f in schema], schema=schema)

    return docs.mapInArrow(scored, out)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out("doc_id"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, train_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
