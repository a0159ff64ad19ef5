"""Secret scans: fixed patterns plus character Markov models.

Two first-order Markov chains over the characters of tokens, one of random strings and
one of ordinary identifiers, are counted from labelled samples. A token (a maximal run of
letters, digits and ``+/_=-``, at least ``min_chars`` long, with a digit and a letter) is a
secret if the log-likelihood ratio of the chains reaches ``threshold``, in sum and per
character. The patterns find named assignments, access keys and hex strings; spans of the
model that touch none of theirs are added with kind ``random``.

Defined results: null and empty texts have no spans; positions are code points, end
exclusive; repeated rows give equal rows; without samples the chains are equal and add
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.blocks import Block, lean, text_blocks
from colscope.session import ship_package

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.zeros(256, np.int64)          # 0: not part of a token
for _i, _c in enumerate(CHARS):
    _CODE[ord(_c)] = _i + 1
_N = len(CHARS) + 1
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_IS_DIGIT = (_CODE > 52) & (_CODE <= 62)
_IS_LETTER = (_CODE > 0) & (_CODE <= 52)

SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


@dataclass
class Model:
    ratio: np.ndarray       # log P(next | previous) under random strings minus under identifiers
    min_chars: int = 16
    threshold: float = 12.0
    per_char: float = 0.6


def base_spans(text: str, hex_runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that are long enough."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if hex_runs:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return out


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs inside one text that have at least ``least`` bytes."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    if len(at) < 2:
        return at[:0], at[:0]
    start, end = at[:-1], at[1:]
    ok = (end - start >= least) & inside[start]
    return start[ok], end[ok]


def spans_of(b: Block, model: Model) -> dict[int, list[tuple[str, int, int, float]]]:
    """Spans of each row of a block that has any, by start and then kind."""
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    data, offsets = b.data, b.offsets
    if not len(data):
        return {}
    byte_spans: dict[int, list[tuple[int, int, int, float]]] = {}
    start, end = _runs(_IS_HEX[data], offsets, HEX_CHARS)       # a maximal hex run is what the pattern matches
    for r, s, e in zip(np.searchsorted(offsets, start, "right") - 1, start.tolist(), end.tolist()):
        byte_spans.setdefault(int(r), []).append((s, 2, e, 0.0))
    code = _CODE[data]
    start, end = _runs(code > 0, offsets, model.min_chars)
    if len(start):
        step = np.zeros(len(data) + 1)
        np.cumsum(model.ratio[np.concatenate([[0], code[:-1]]), code], out=step[1:])
        first = model.ratio[0, code[start]]      # a token's first character follows no other
        score = step[end] - step[start + 1] + first
        digits, letters = np.concatenate([[0], np.cumsum(_IS_DIGIT[data])]), np.concatenate([[0], np.cumsum(_IS_LETTER[data])])
        ok = ((score >= model.threshold) & (score >= model.per_char * (end - start))
              & (digits[end] > digits[start]) & (letters[end] > letters[start]))
        for r, s, e, x in zip(np.searchsorted(offsets, start[ok], "right") - 1, start[ok].tolist(), end[ok].tolist(), score[ok].tolist()):
            byte_spans.setdefault(int(r), []).append((s, 3, e, x))
    for i in range(b.n):
        raw = b.text(i)
        low = raw.lower()
        spans = []
        if b"AKIA" in raw or any(w in low for w in _WORDS):
            spans = [(s, k, e, 0.0) for s, k, e in base_spans(raw.decode(), hex_runs=False)]
        if i in byte_spans:
            at = int(offsets[i])
            if raw.isascii():
                spans += [(s - at, k, e - at, x) for s, k, e, x in byte_spans[i]]
            else:       # code points before each byte
                points = np.concatenate([[0], np.cumsum((data[at:offsets[i + 1]] & 0xC0) != 0x80)])
                spans += [(int(points[s - at]), k, int(points[e - at]), x) for s, k, e, x in byte_spans[i]]
        if spans:
            found[i] = spans
    out = {}
    for i, spans in found.items():
        base = sorted(x for x in spans if x[1] < 3)
        kept = list(base)
        for x in spans:
            if x[1] == 3 and not any(s < x[2] and x[0] < e for s, _, e, _ in base):
                kept.append(x)
        out[i] = [(KINDS[k], s, e, x) for s, k, e, x in sorted(kept)]
    return out


def pairs_of(tokens: DataFrame) -> DataFrame:
    """(label, previous, next, n): character pairs of the labelled tokens (token, label), counted by Spark."""
    code = F.array(*[F.lit(int(c)) for c in _CODE[:128]])
    at = lambda c: F.when(F.ascii(c) < 128, F.element_at(code, F.ascii(c) + 1)).otherwise(F.lit(0))
    chars = F.transform(F.split("token", ""), lambda c: F.when(c == "", F.lit(0)).otherwise(at(c)))
    pairs = F.expr("transform(sequence(1, greatest(size(codes) - 1, 1)), i -> struct(codes[i - 1] as prev, codes[i] as next))")
    return (tokens.filter(F.length("token") > 0).select("label", F.concat(F.array(F.lit(0)), chars).alias("codes"))
            .select("label", F.explode(pairs).alias("p")).filter("p.next > 0")
            .groupBy("label", F.col("p")["prev"].alias("prev"), F.col("p")["next"].alias("next")).agg(F.count("*").alias("n")))


def fit(samples: DataFrame, smooth: float = 0.5, **limits) -> Model:
    """Train both chains on ``samples`` (token, label: 1 random string, 0 identifier)."""
    counts = np.zeros((2, _N, _N))
    for r in pairs_of(samples.filter(F.col("label").isin(0, 1))).collect():      # at most 2 x 68 x 67 rows
        counts[r["label"], r["prev"], r["next"]] += r["n"]
    chance = counts + smooth
    chance[:, :, 0] = 0
    chance /= chance.sum(2, keepdims=True)
    ratio = np.zeros((_N, _N))
    ratio[:, 1:] = np.log(chance[1, :, 1:]) - np.log(chance[0, :, 1:])
    if not counts[0].any() or not counts[1].any():
        ratio[:] = 0
    return Model(ratio, **limits)


def labelled_tokens(docs: DataFrame, rows: int = 2000, random_strings: int = 4000, seed: int = 11,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Training samples: the texts of ``rows`` documents (chosen by a hash of the id) give
    the pattern matches' values as random strings and their other tokens, single and joined
    as identifiers, as ordinary ones; seeded random strings over common alphabets join the former."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = docs.select("id").filter("id is not null").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows)
    texts = docs.join(F.broadcast(ids), "id", "left_semi").select("text")
    found = texts.select(F.expr(r"""regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["\']? *[:=] *["\']?([A-Za-z0-9+/_.=-]{12,})', 1)""").alias("a"),
                         F.expr(r"regexp_extract_all(text, 'AKIA[A-Z0-9]{14,}', 0)").alias("b"),
                         F.expr(r"regexp_extract_all(text, '\\b[0-9a-f]{16,}\\b', 0)").alias("c"))
    secret = found.select(F.explode(F.concat("a", "b", "c")).alias("token")).filter("token rlike '[0-9]'").distinct()
    words = texts.select(F.explode(F.expr(r"regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*', 0)")).alias("token"))
    plain = words.filter("length(token) <= 24 and not (token rlike '[0-9].*[A-Za-z].*[0-9]')").distinct()
    joined = plain.select(F.concat_ws("_", F.lower("token"), F.lit("id"), F.lit("2024")).alias("token"),
                          ).union(plain.select(F.concat(F.initcap("token"), F.lit("-v1/")).alias("token")))
    rng = np.random.default_rng(seed)
    alphabets = [CHARS[:62], CHARS[:26] + CHARS[52:62], CHARS[26:62], "0123456789abcdef", CHARS[:64], CHARS[:62] + "_-"]
    made = [("".join(rng.choice(list(alphabets[i % len(alphabets)]), int(rng.integers(16, 48)))), 1) for i in range(random_strings)]
    return (spark.createDataFrame(made, "token string, label int")
            .union(secret.select("token", F.lit(1)))
            .union(plain.select("token", F.lit(0))).union(joined.select("token", F.lit(0))))


def find_secrets(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of every row; ``spans`` is empty where nothing was found."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # a 68 x 68 matrix
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for b in text_blocks(batch.column(1)):
                spans = spans_of(b, shared.value)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(b.first, b.n),
                    pa.array([[dict(zip(("kind", "start", "end", "score"), x)) for x in spans.get(i, ())] for i in range(b.n)], kind)],
                    [id_col, "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` long, spans {SPAN}")


def redact(docs: DataFrame, model: Model, text_col: str = "text", chars_col: str | None = "n_chars",
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark``; spans that overlap are one.
    ``chars_col``, if given, gets the changed texts' number of code points. Texts without
    a span stay as they are, null included."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            size = batch.schema.get_field_index(chars_col) if chars_col else -1
            new: dict[int, str] = {}
            for b in text_blocks(batch.column(at)):
                for i, spans in spans_of(b, shared.value).items():
                    text, out, end = b.text(i).decode(), [], 0
                    for _, s, e, _ in spans:
                        if s >= end:
                            out += [text[end:s], mark]
                        end = max(end, e)
                    new[b.first + i] = "".join(out) + text[end:]
            if not new:
                yield batch
                continue
            cols = list(batch.columns)
            cols[at] = pa.array([new.get(i, t) for i, t in enumerate(cols[at].to_pylist())], cols[at].type)
            if size >= 0:
                cols[size] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(cols[size].to_pylist())], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
