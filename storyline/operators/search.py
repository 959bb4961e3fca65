"""Keyword search over titles: positional postings, MATCH expressions, BM25, and a kept index that follows the titles' changes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import Store, Transaction
from .durable import durable

K1, B = 1.2, 0.75
#: Segments of one size class that are merged into one, and the step from class to class.
FANOUT = 4
WORD = r"([\p{L}\p{N}]+)"
POSTINGS = "id string, term string, positions array<int>, length int, segment long"
DOCS = "id string, hash long, length int, alive boolean, segment long"


def postings(rows: DataFrame, key: str = "id", text: str = "title") -> DataFrame:
    """``(key, term, tf, length)``: lower-case runs of letters and digits."""
    listed = rows.select(key, _terms(text).alias("terms"))
    terms = listed.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    # A filter on terms reaches below this aggregate.
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").cast("long").alias("length"))


def sizes(rows: DataFrame, text: str = "title") -> DataFrame:
    """One row: ``docs`` with any term, and the ``mean`` of their terms."""
    return rows.select(F.size(_terms(text)).alias("length")).where("length > 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))


def _terms(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def matches_all(index: DataFrame, terms: list[str], key: str = "id") -> DataFrame:
    """Keys whose text holds every term."""
    wanted = sorted({t.lower() for t in terms})
    found = index.where(F.col("term").isin(wanted)).groupBy(key).agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(wanted)).select(key)


def bm25(index: DataFrame, terms: list[str], key: str = "id", size: DataFrame | None = None) -> DataFrame:
    """``(key, rank)`` of texts with any term, by Okapi BM25; higher is better. ``size`` is one row of ``docs`` and ``mean``, if known."""
    wanted = sorted({t.lower() for t in terms})
    if size is None:
        size = index.groupBy(key).agg(F.first("length").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    hits = index.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # size is one row and df one row a term: both broadcast by their own bound.
    return hits.join(F.broadcast(df), "term").join(F.broadcast(size)).groupBy(key).agg(F.sum(idf * weight).alias("rank"))


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and what they are without."""
    pairs = [(chr(c), base[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(base := [x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)]) == 1 and base[0] != chr(c)]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


MARKED, PLAIN = _folds()


def folded(text: Column) -> Column:
    """Lower case and without marks, as terms are compared."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(1))


def positional(rows: DataFrame, key: str = "id", text: str = "title") -> DataFrame:
    """``(key, term, positions, length)``: where each text's terms stand, from 0."""
    split = rows.select(F.col(key), tokens(F.col(text)).alias("terms"))
    placed = split.select(key, F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term"))
    return placed.groupBy(key, "term").agg(F.sort_array(F.collect_list("at")).alias("positions"), F.first("length").alias("length"))


_PART = re.compile(r'\s*(?:(?P<op>AND\b|OR\b|NOT\b|[()+])|"(?P<phrase>(?:[^"]|"")*)"\s*(?P<starred>\*?)|(?P<word>[^\s()"+*]+)\s*(?P<star>\*?))')


class Match:
    """A MATCH expression: words, "phrases", a + b (phrases joined), prefix*, AND (also unsaid), OR, NOT and brackets.

    NOT binds most, then AND, then OR; operators are upper case. A word that
    holds more than one term is a phrase of them.
    """

    def __init__(self, expression: str) -> None:
        self.leaves: list[tuple[list[str], bool]] = []
        self._parts, at = [], 0
        while expression[at:].strip():
            found = _PART.match(expression, at)
            if not found:
                raise ValueError(f"cannot read {expression[at:]!r}")
            self._parts.append(found)
            at = found.end()
        self.test = self._either()
        if self._parts:
            raise ValueError(f"not expected: {self._parts[0][0].strip()!r}")

    def _next(self, *ops: str) -> bool:
        if self._parts and self._parts[0]["op"] in ops:
            self._parts.pop(0)
            return True
        return False

    def _either(self) -> Callable[[list[Column]], Column]:
        found = self._all()
        while self._next("OR"):
            found = (lambda a, b: lambda held: a(held) | b(held))(found, self._all())
        return found

    def _all(self):
        found = self._without()
        while self._next("AND") or self._parts and self._parts[0]["op"] not in ("OR", ")", "NOT"):
            found = (lambda a, b: lambda held: a(held) & b(held))(found, self._without())
        return found

    def _without(self):
        found = self._one()
        while self._next("NOT"):
            found = (lambda a, b: lambda held: a(held) & ~b(held))(found, self._one())
        return found

    def _one(self):
        if self._next("("):
            found = self._either()
            if not self._next(")"):
                raise ValueError("a bracket is not closed")
            return found
        terms, prefix = [], False
        while True:
            if not self._parts or self._parts[0]["op"]:
                raise ValueError("a word is missing")
            part = self._parts.pop(0)
            text = part["word"] if part["word"] is not None else part["phrase"]
            plain = text.lower().translate(str.maketrans(MARKED, PLAIN))
            terms += re.findall(r"[^\W_]+", plain)
            prefix = bool(part["star"] or part["starred"])
            if not self._next("+"):
                break
        leaf = len(self.leaves)
        self.leaves.append((terms, prefix))
        return lambda held: held[leaf]

    def wanted(self, term: Column) -> Column:
        """Whether a posting of ``term`` matters at all."""
        exact = sorted({t for terms, prefix in self.leaves for t in (terms[:-1] if prefix else terms)})
        test = term.isin(exact) if exact else F.lit(False)
        for start in sorted({terms[-1] for terms, prefix in self.leaves if prefix and terms}):
            test = test | term.startswith(start)
        return test

    def keys(self, index: DataFrame, key: str = "id") -> DataFrame:
        """Keys of positional postings whose text matches: one aggregate of the wanted postings, all leaves at once."""
        term, found, held = F.col("term"), [], []
        for number, (terms, prefix) in enumerate(self.leaves):
            tests = [term.startswith(t) if prefix and k == len(terms) - 1 else term == t for k, t in enumerate(terms)]
            if len(terms) == 1:
                found.append(F.coalesce(F.max(tests[0]), F.lit(False)).alias(f"l{number}"))
                held.append(F.col(f"l{number}"))
            elif not terms:
                held.append(F.lit(False))
            else:
                for k, test in enumerate(tests):
                    found.append(F.flatten(F.collect_list(F.when(test, F.col("positions")))).alias(f"l{number}_{k}"))
                after = [f"array_contains(l{number}_{k}, p + {k})" for k in range(1, len(terms))]
                held.append(F.expr(f"exists(l{number}_0, p -> {' and '.join(after)})"))
        if not found:
            return index.select(key).limit(0)
        return index.where(self.wanted(term)).groupBy(key).agg(*found).where(self.test(held)).select(key)


class TitleIndex:
    """A kept index of ``(id, title)`` in a store: segments of postings and of documents, each of one change.

    A document's latest segment holds; a removed one leaves a row that says so.
    Segments of like size are merged, and what no longer holds goes with that.
    Parquet is sorted by term, so a search reads the row groups of its terms.
    """

    def __init__(self, store: Store, name: str = "title_index") -> None:
        self.store, self.postings, self.docs = store, f"{name}_postings", f"{name}_docs"

    def sync(self, rows: DataFrame) -> dict[str, int]:
        """Takes over what has changed in ``rows`` (all documents) since the last time: new, changed and removed ones."""
        return self.store.transact(lambda tx: self.change(tx, rows, None))

    def update(self, rows: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Takes over ``rows`` (new or changed documents) and lets ``removed`` (id) go; others stay as they are."""
        return self.store.transact(lambda tx: self.change(tx, rows, removed or rows.select("id").limit(0)))

    def _live(self, docs: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("hash", "length", "alive", "segment"), "segment").alias("d")
        return docs.groupBy("id").agg(last).select("id", "d.*")

    def change(self, tx: Transaction, rows: DataFrame, removed: DataFrame | None) -> dict[str, int]:
        """As :meth:`update` (``removed`` None: as :meth:`sync`), part of what a transaction commits."""
        number = max((int(k.split("#")[1]) for k in tx.entries if k.split("#")[0] == self.docs), default=0) + 1
        rows = rows.select(F.col("id").cast("string").alias("id"), "title").withColumn("hash", F.xxhash64(F.coalesce("title", F.lit(""))))
        stored = tx.read(self.docs)
        if stored is not None:
            known = self._live(stored).where("alive")
            changed = rows.join(known.select("id", "hash"), ["id", "hash"], "left_anti")
            gone = known.join(rows, "id", "left_anti") if removed is None else known.join(removed.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
        else:
            changed, gone = rows, None
        changed = durable(changed)
        docs = changed.select("id", "hash", F.size(tokens(F.coalesce("title", F.lit("")))).alias("length"), F.lit(True).alias("alive"), F.lit(number).cast("long").alias("segment"))
        if gone is not None:
            docs = docs.unionByName(gone.select("id", "hash", "length", F.lit(False).alias("alive"), F.lit(number).cast("long").alias("segment")))
        docs = durable(docs)
        counts = {r["alive"]: r["count"] for r in docs.groupBy("alive").count().collect()}
        if counts:
            new = positional(changed).select("id", "term", "positions", "length", F.lit(number).cast("long").alias("segment"))
            tx.append(self.docs, number, docs)
            tx.append(self.postings, number, self._in_order(new))
            self._merge(tx, number)
        return {"changed": counts.get(True, 0), "removed": counts.get(False, 0)}

    def _in_order(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("term").sortWithinPartitions("term", "id")

    def _merge(self, tx: Transaction, number: int) -> None:
        """While FANOUT segments of a size class are there, they become one."""
        classes: dict[int, list[str]] = {}
        for name, size in tx.sizes(self.postings).items():
            classes.setdefault(max(size, 1).bit_length() // FANOUT.bit_length(), []).append(name.split("#")[1])
        for segments in (s for s in classes.values() if len(s) >= FANOUT):
            live = durable(self._live(tx.read(self.docs)))
            alive = live.where("alive").select("id", "segment")
            held = tx.read_buckets(self.postings, segments).join(alive, ["id", "segment"], "left_semi")
            own = tx.read_buckets(self.docs, segments).join(live.select("id", "segment"), ["id", "segment"], "left_semi")
            # A removal has to be remembered only while an older segment may still hold what it removes.
            if len(segments) == len(tx.sizes(self.docs)):
                own = own.where("alive")
            held, own = durable(held), durable(own)
            tx.drop(self.postings, segments)
            tx.drop(self.docs, segments)
            tx.append(self.postings, int(max(segments, key=int)), self._in_order(held))
            tx.append(self.docs, int(max(segments, key=int)), own)

    def search(self, expression: str) -> DataFrame:
        """``(id)`` of the documents that match."""
        tx, match = self.store.transaction(), Match(expression)
        index, docs = tx.read(self.postings), tx.read(self.docs)
        if index is None:
            return self.store.spark.createDataFrame([], "id string")
        return match.keys(self._held(index.where(match.wanted(F.col("term"))), docs))

    def _held(self, index: DataFrame, docs: DataFrame) -> DataFrame:
        """Postings that still hold: only the documents they name are looked up."""
        index = durable(index)
        live = self._live(docs.join(index.select("id").distinct(), "id", "left_semi")).where("alive").select("id", "segment")
        return index.join(live, ["id", "segment"], "left_semi")

    def ranked(self, expression: str) -> DataFrame:
        """``(id, rank)`` of the documents that match, by BM25 over the expression's whole terms; higher is better."""
        tx, match = self.store.transaction(), Match(expression)
        index, docs = tx.read(self.postings), tx.read(self.docs)
        if index is None:
            return self.store.spark.createDataFrame([], "id string, rank double")
        held = durable(self._held(index.where(match.wanted(F.col("term"))), docs))
        size = self._live(docs).where("alive and length > 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
        terms = sorted({t for terms, _ in match.leaves for t in terms})
        scored = bm25(held.withColumn("tf", F.size("positions")), terms, size=size)
        return match.keys(held).join(scored, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))
