"""Language identification by a string kernel.

The kernel of two texts is the share of n-grams (1 to ``MAX_GRAM`` bytes, a blended
spectrum) present in both, |x & y| / sqrt(|x| |y|), over lower-cased texts in which all but
letters is a space; n-grams are hashed to ``DIMS`` presence bits. ``fit`` takes a bounded
sample of labelled rows (``per_language`` rows of each language, fewer of each if ``max_rows``
is shared by many, one at least), some of them as Nystroem landmarks; the kernel to the landmarks, whitened, gives a row's
features, and kernel ridge regression, one against the rest, its scores. The sample's presence
bits alone reach the driver. Scoring multiplies blocks of presence rows by one matrix of
``DIMS`` rows: no shuffle.

Defined results: a null text and one without a letter is ``und`` with score 0, and so is every
text if nothing was learned; the score is the winner's share of the (clipped) one-against-rest
values; ties go to the first language by name; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.blocks import Block, mix, text_blocks
from colscope.llm.tables import small_or_shuffled, written
from colscope.session import ship_package

MAX_GRAM = 4
DIMS = 8192
LANDMARKS = 128
PER_LANGUAGE = 400
MAX_ROWS = 25_600

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray     # (DIMS, languages): normalised landmarks, whitening and ridge weights in one
    bias: np.ndarray


def presence(b: Block) -> np.ndarray:
    """n x DIMS matrix of the n-grams that occur, scaled to unit length."""
    x = np.zeros((b.n, DIMS), np.float32)
    c = _FOLD[b.data].astype(np.uint64)
    row = np.repeat(np.arange(b.n), np.diff(b.offsets))
    code = np.zeros(len(c), np.uint64)
    spaces = c == 32
    blank = spaces.copy()
    for n in range(1, MAX_GRAM + 1):
        if len(c) < n:
            break
        size = len(c) - n + 1
        code = (code[:size] << np.uint64(8)) | c[n - 1:]
        blank = blank[:size] & spaces[n - 1:]
        ok = ~blank & (row[:size] == row[n - 1:])
        at = (mix(code[ok] + np.uint64(n << 40)) & np.uint64(DIMS - 1)).astype(np.int64)
        x[row[:size][ok], at] = 1
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    return x


def _parts(col, rows: int = 128):
    for b in text_blocks(col, 1 << 18):
        for lo in range(0, b.n, rows):
            hi = min(lo + rows, b.n)
            yield Block(b.first + lo, b.data[b.offsets[lo]:b.offsets[hi]], b.offsets[lo:hi + 1] - b.offsets[lo])


def _sample(rows: DataFrame, per_language: int, max_rows: int, seed: int) -> list[tuple[str, np.ndarray]]:
    """(language, presence) of the bounded sample, in a fixed order. ``rows``: id, text, lang."""
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("text"))
    rows = rows.withColumn("h", order)
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "languages")
    languages = counts.count()
    if not languages:
        return []
    each = max(1, min(per_language, max_rows // languages))
    # a row is in if its hash is under its language's rate, about 1.3 x each rows, or is the least one
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.least(F.lit(1.0), F.lit(1.3 * each) / F.col("n"))
    picked = (rows.join(small_or_shuffled(counts, 64), "lang").filter((unit < rate) | (F.col("h") == F.col("least")))
              .select("lang", "h", F.lower("text").alias("text")))

    def run(batches):
        for batch in batches:
            for b in _parts(batch.column(2)):
                bits = np.packbits(presence(b) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(b.first, b.n), batch.column(1).slice(b.first, b.n),
                    pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "h", "bits"])

    got: dict[str, list] = {}
    for r in picked.mapInArrow(run, "lang string, h long, bits binary").collect():
        got.setdefault(r["lang"], []).append((r["h"], bytes(r["bits"])))
    out = []
    for lang in sorted(got):
        for _, bits in sorted(got[lang])[:each]:
            x = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.float32)
            out.append((lang, x / max(np.sqrt(x.sum()), 1)))
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS,
        ridge: float = 1e-2, seed: int = 5) -> Model:
    """Learn from rows with a non-null language and a letter."""
    ship_package(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = _sample(rows, per_language, max_rows, seed)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32))
    x = np.stack([v for _, v in sample])
    y = np.array([[1.0 * (lang == k) for k in languages] for lang, _ in sample])
    # landmarks: the same number of each language, as far as it has them
    each = max(1, landmarks // len(languages))
    place: dict[str, int] = {}
    marks = []
    for i, (lang, _) in enumerate(sample):
        if place.setdefault(lang, 0) < each:
            place[lang] += 1
            marks.append(i)
    m = x[marks]
    values, vectors = np.linalg.eigh((m @ m.T).astype(np.float64))
    use = values > 1e-6 * values[-1]
    white = vectors[:, use] / np.sqrt(values[use])
    z = (x @ m.T).astype(np.float64) @ white
    mean = z.mean(0)
    weight = 1 / np.maximum(y.sum(0), 1)            # every language counts alike
    s = (y * weight).sum(1)[:, None]
    zc = z - mean
    w = np.linalg.solve(zc.T @ (s * zc) + ridge * len(languages) / len(sample) * np.eye(zc.shape[1]), zc.T @ (s * (y - 1 / len(languages))))
    full = white @ w
    return Model(languages, (m.T @ full).astype(np.float32), (1 / len(languages) - mean @ w).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # DIMS x languages: a bounded size

    def run(batches):
        mod = shared.value
        names = np.array(mod.languages or ["und"], object)
        for batch in batches:
            letter = np.array(batch.column(2).to_pylist(), bool)
            for b in _parts(batch.column(1)):
                known = letter[b.first:b.first + b.n] & bool(mod.languages)
                f = np.clip(presence(b) @ mod.weights + mod.bias, 1e-6, None) if mod.languages else np.ones((b.n, 1))
                best = f.argmax(1)
                share = np.where(known, f.max(1) / f.sum(1), 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(b.first, b.n), pa.array(np.where(known, names[best], "und"), pa.string()),
                    pa.array(share)], [id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long"), F.lower(text_col).alias("_text"),
                       F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return rows.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")
