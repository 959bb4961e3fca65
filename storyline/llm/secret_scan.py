"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import pieces

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")

#: Characters the models know; everything else is the boundary symbol 0.
ALPHABET = string.ascii_letters + string.digits + "+/_-="
STATES = len(ALPHABET) + 1
#: Runs that the models judge, and the log-likelihood ratio (in all, and per character) that makes one a secret.
LEAST_RUN = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
LEAST_RATIO, LEAST_RATIO_PER_CHARACTER = 12.0, 1.2
#: A shape whose parts are random by making, and no secret.
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: How much the corpus counts at most against the labelled samples.
CORPUS_WEIGHT = 4.0
#: Weight of a character's own frequency against its counts after another.
BACKOFF = 8.0
#: Signs that join words into ordinary identifiers.
JOINS = "_-/+="
#: Labelled random strings of each alphabet, and ordinary numbers, that are generated for training.
GENERATED = 400

_CODE = np.zeros(256, np.int64)
for _n, _c in enumerate(ALPHABET, 1):
    _CODE[ord(_c)] = _n


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of all base matches, in code points, by start and kind."""
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), kind, m.end(), m.start(), m.end()) for kind, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    return sorted(found)


def _transitions(data: bytes) -> np.ndarray:
    """Cells of each symbol after the two before it, in ``data`` with boundaries at either end."""
    codes = _CODE[np.frombuffer(b"  " + data + b" ", np.uint8)]
    return (codes[:-2] * STATES + codes[1:-1]) * STATES + codes[2:]


def _counted(samples: Iterable[bytes]) -> np.ndarray:
    return np.bincount(_transitions(b"  ".join(samples)), minlength=STATES**3)


class RandomnessModel:
    """Second-order character models of random strings and of ordinary identifiers."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray) -> None:
        logs = []
        for counts in (random_counts, ordinary_counts):
            triples = counts.reshape(STATES, STATES, STATES).astype(float)
            triples[0, 0, 0] = 0
            pairs = triples.sum(axis=0)
            single = pairs.sum(axis=0) + 0.5
            # Histories with little evidence lean on shorter ones, these on how frequent the next character is.
            lower = pairs + BACKOFF * single / single.sum()
            lower /= lower.sum(axis=1, keepdims=True)
            smooth = triples + BACKOFF * lower
            logs.append(np.log(smooth / smooth.sum(axis=2, keepdims=True)))
        self.ratio = (logs[0] - logs[1]).astype(np.float32).ravel()

    def score(self, run: str) -> float:
        """Log-likelihood ratio of ``run`` being random: the sum over its characters after two others of it."""
        codes = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        return float(self.ratio[(codes[:-2] * STATES + codes[1:-1]) * STATES + codes[2:]].sum(dtype=np.float64))

    def spans(self, text: str, taken: list[tuple]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of what is judged random of runs, each without what spans of ``taken`` cover of it."""
        found, covered = [], _covered(taken)
        ends = [e for _, e in covered]
        for m in CANDIDATE.finditer(text):
            at, last = m.span()
            for k in range(bisect_right(ends, at), len(covered) + 1):
                start, end = covered[k] if k < len(covered) else (last, last)
                if min(start, last) - at >= LEAST_RUN and self.random(text[at : min(start, last)]):
                    found.append((at, 3, min(start, last)))
                at = end
                if at >= last:
                    break
        return found

    def random(self, run: str) -> bool:
        score = self.score(run)
        return score >= LEAST_RATIO and score >= LEAST_RATIO_PER_CHARACTER * len(run) and not UUID.fullmatch(run)


def _covered(spans: list[tuple]) -> list[tuple[int, int]]:
    """What ``spans`` cover, as rising intervals that don't meet."""
    out: list[tuple[int, int]] = []
    for start, _, end, *_ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _ordinary_samples(dice: random.Random) -> Iterator[bytes]:
    """Labelled ordinary runs of more kinds than a corpus need hold: prose and names of code, rules and padding, rows of the alphabet, dates, numbers, versions."""
    import builtins
    import keyword
    import sys

    from pydoc_data import topics  # the language's own manual: English prose and code

    prose = " ".join(topics.topics.values())
    words = re.findall(r"[A-Za-z]+", prose)
    yield prose.encode("utf-8", "replace")
    names = sorted({*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names})
    yield " ".join(names).encode()
    for _ in range(GENERATED * 20):
        some = dice.choices(words, k=dice.randint(2, 5))
        yield dice.choice([*JOINS, ""]).join(some if dice.random() < 0.5 else map(str.lower, some)).encode()
        yield "".join(w.capitalize() for w in some).encode()
        yield "_".join(w.upper() for w in some).encode()
    for row in (string.ascii_lowercase, string.ascii_uppercase, string.digits, "qwertyuiop", "asdfghjkl", "zxcvbnm"):
        yield from (row.encode() * 8, row[::-1].encode() * 8)
    for sign in ALPHABET:
        for n in (16, 24, 40, 80):
            yield sign.encode() * n
    for _ in range(GENERATED):
        year, rest = str(dice.randint(1900, 2100)), [f"{dice.randint(0, most):02d}" for most in (12, 31, 23, 59, 59)]
        day, clock = "-".join([year, *rest[:2]]), "-".join(rest[2:])
        yield from (x.encode() for x in (f"{day}T{clock}Z", f"{day}_{clock}", f"{year}{''.join(rest)}", f"{day}/{clock}"))
        yield "".join(dice.choices(string.digits, k=dice.randint(4, 24))).encode()
        yield dice.choice(["v", "release-", "version_", "build-"]).encode() + "-".join(str(dice.randint(0, 40)) for _ in range(dice.randint(2, 6))).encode()


def train(docs: DataFrame) -> RandomnessModel:
    """Both models from labelled samples over all documents.

    Random strings: the values that base patterns find, and GENERATED seeded
    random ones per alphabet. Ordinary identifiers: all other text, as words and
    joined, and the samples of _ordinary_samples. Executors send sums of
    transitions only (two matrices of STATES^3 cells a partition, added up by
    cell before they reach the driver). The corpus's own share is scaled to
    CORPUS_WEIGHT times that of the samples, whatever its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, STATES**3), np.int64)
        for batch in pieces(batches, "text"):
            for text in batch["text"].to_pylist():
                at, rest, values = 0, [], []
                for _, _, _, start, end in sorted(base_spans(text), key=lambda s: s[3]):
                    values.append(text[start:end].encode("ascii"))
                    rest.append(text[at:start])
                    at = max(at, end)
                rest.append(text[at:])
                for label, part in ((0, values), (1, [" ".join(rest).encode("utf-8", "replace")])):
                    cells, times = np.unique(_transitions(b"  ".join(part)), return_counts=True)
                    totals[label, cells] += times
        label, cell = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(cell), pa.array(totals[label, cell])], names=["label", "cell", "n"])

    rows = (
        docs.select("text").where("text is not null").mapInArrow(run, "label long, cell long, n long")
        .groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    )
    totals = np.zeros((2, STATES**3))
    totals[rows["label"].to_numpy(), rows["cell"].to_numpy()] = rows["n"].to_numpy()
    _join_words(totals[1].reshape(STATES, STATES, STATES))
    dice = random.Random(0)
    made = [
        "".join(dice.choices(alphabet, k=32)).encode("ascii")
        for alphabet in ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_lowercase, ALPHABET) for _ in range(GENERATED)
    ]
    samples = (_counted(made), _counted(_ordinary_samples(dice)))
    return RandomnessModel(*(own + total * min(1.0, CORPUS_WEIGHT * own.sum() / max(total.sum(), 1)) for own, total in zip(samples, totals, strict=True)))


def _join_words(counts: np.ndarray) -> None:
    """Adds to ordinary ``counts`` what the same words give as identifiers: joined by each of JOINS, and in camel case."""
    starts, ends = counts[0].copy(), counts[:, :, 0].copy()  # (first, second) and (last but one, last) letters of words
    starts[0] = starts[:, 0] = 0
    ends[0] = ends[:, 0] = 0
    first, last = starts.sum(axis=1), ends.sum(axis=0)
    if not first.sum() or not last.sum():
        return
    for sign in JOINS:
        at = int(_CODE[ord(sign)])
        counts[:, :, at] += ends
        counts[:, at, :] += np.outer(last, first) / first.sum()
        counts[at] += starts
    lower, upper = (_CODE[np.frombuffer(letters.encode(), np.uint8)] for letters in (string.ascii_lowercase, string.ascii_uppercase))
    capital, second = first[lower] + first[upper], starts[lower] + starts[upper]
    counts[:, :, upper] += ends[:, :, None] * (capital / capital.sum() if capital.sum() else capital)
    counts[:, upper, :] += np.einsum("i,jk->ijk", last, second / max(second.sum(), 1))


def _listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


def find_secrets(docs: DataFrame, model: RandomnessModel | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_markov, base_spans, spans)`` per document.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind, comma-joined. Null texts are empty and have none; null ids, repeated
    rows and extra columns are passed by; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                added = model.value.spans(text, base)
                kinds = [s[1] for s in base]
                out.append((*(kinds.count(k) for k in range(3)), len(added), _listed(base), _listed(sorted([*(s[:3] for s in base), *added]))))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*out, strict=True)))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_spans", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_spans string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and n_chars set anew; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [x if x is None else _redacted(x, model.value, mark) for x in batch["text"].to_pylist()]
            put = {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                put["n_chars"] = pa.array([n if x is None else len(x) for x, n in zip(texts, batch["n_chars"].to_pylist(), strict=True)], batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays([put.get(c, batch[c]) for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, model: RandomnessModel, mark: str) -> str:
    base = base_spans(text)
    values = sorted([(s[3], s[4]) for s in base] + [(s, e) for s, _, e in model.spans(text, base)])
    out, at = [], 0
    for start, end in values:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def base_digest(listed: str) -> str:
    """SHA-256 of a span list, as Spark's sha2 gives it."""
    return hashlib.sha256(listed.encode()).hexdigest()
