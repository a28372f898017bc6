"""Quality rules from tokeniser fertility.

Every text's words (runs without ASCII white space) are encoded by public
vocabularies, each word on its own, so a measure does not depend on where a
long text is cut into pieces. Per vocabulary: characters per token, share of
byte-fallback tokens (byte pieces; for a byte-level vocabulary, tokens that
are not whole characters) and entropy of the token distribution in bits.

A text is judged by bands of its group: its language if known, else its main
script, and its size class (powers of four of its words). The bands come from
the whole corpus: quartiles of each measure over the group's distinct texts
that pass the base rules (counted in bins, so they are exact to a bin and do
not depend on how the rows were dealt), widened by ``REACH`` quartile ranges
and at least by the measure's ``SLACK``. Copies count once, so a group of
copies does not become the norm. Groups of fewer than ``LEAST_TEXTS`` distinct
texts have the wide bands fixed for their script.

Base rules: at least ``LEAST_WORDS`` words, and at most half of the words in
three-word windows that occur twice or more.

Defined cases: a null text has no words, so it fails the base rules, as an
empty one does; null ids pass through; repeated rows are judged alike, each
for itself; a text without letters has the script ``none``; a null language
is replaced by the script; an empty table gives no rows; other columns are
ignored, whatever their names. Long texts are encoded in pieces cut at white
space, and counted whole.
"""

from __future__ import annotations

import base64
import itertools
import os
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import ship, words
from ledgerlens.llm.common import saved, small_batches
from ledgerlens.operators.joins import broadcast_if_small

ship(__name__, words.__name__)

LEAST_WORDS = 50
# Of 100 words, how many may lie in repeated three-word windows.
REPEAT_SHARE = 50
SYMBOLS = b"#*$%&|<>"
# Distinct texts a group needs for bands of its own.
LEAST_TEXTS = 200
# Quartile ranges beyond the quartiles, and the least reach: a share of the
# median for characters per token and entropy, a plain share for bytes.
REACH = 3.0
SLACK = {"chars": 0.1, "bytes": 0.1, "bits": 0.1}
# Width of the bins in which measures are counted.
BIN = 0.005
# Bytes of a text handled at once, and words whose tokens a worker keeps.
PIECE = 1 << 20
KEPT_WORDS = 200_000

# First code point of the ranges of letters of a script, by
# ascending code point ("" ends a range).
SCRIPT_STARTS = [
    (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xC0, "Latin"), (0xD7, ""),
    (0xD8, "Latin"), (0xF7, ""), (0xF8, "Latin"), (0x250, ""), (0x370, "Greek"),
    (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
    (0x780, ""), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Lao"),
    (0xF00, ""), (0x1000, "Burmese"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, ""), (0x1780, "Khmer"), (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"),
    (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""),
    (0x20000, "Han"), (0x32000, ""),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS if s})
_STARTS = np.array([0] + [a for a, _ in SCRIPT_STARTS])
_SCRIPT_AT = np.array([-1] + [SCRIPTS.index(s) if s else -1 for _, s in SCRIPT_STARTS])

# Bands of groups too small for their own (least and most
# characters per token, most byte tokens, least bits). Scripts that public
# vocabularies hardly cover are written in bytes, so only the bits count there.
WIDE = {"Latin": (1.2, 12.0, 0.25, 2.5), "Cyrillic": (0.8, 10.0, 0.5, 2.5),
        "Greek": (0.6, 10.0, 0.75, 2.5)}
WIDE_OTHER = (0.15, 12.0, 1.0, 2.0)


class Pieces:
    """A sentencepiece vocabulary with byte pieces."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def encode(self, found: list[str]) -> list[list[int]]:
        return self.model.encode(found, num_threads=1)


class Ranks:
    """A byte-level vocabulary given as ranks."""

    def __init__(self, lines: bytes, pattern: str):
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                       special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_byte[i] = True

    def encode(self, found: list[str]) -> list[list[int]]:
        one = self.model.encode_ordinary
        return [one(" " + w) for w in found]


def vocabulary(path: str, pattern: str):
    """What a worker needs to build the vocabulary of a file."""
    with open(path, "rb") as f:
        return ("ranks" if path.endswith(".tiktoken") else "pieces"), f.read(), pattern


def _built(kind: str, data: bytes, pattern: str):
    return Ranks(data, pattern) if kind == "ranks" else Pieces(data)


class _Numbers(dict):
    """Words by number, a new word gets the next one."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Lexicon:
    """Measures of the distinct words seen."""

    def __init__(self, vocabularies: list):
        self.vocabularies = vocabularies
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.known = 0
        self.chars = np.empty(0, np.int64)
        self.symbols = np.empty(0, np.int64)
        self.scripts = np.empty((0, len(SCRIPTS)), np.int32)
        # Per vocabulary: tokens of all words, and where each word's begin.
        self.tokens = [np.empty(0, np.int32) for _ in self.vocabularies]
        self.ends = [np.zeros(1, np.int64) for _ in self.vocabularies]

    def numbers(self, data: bytes) -> np.ndarray:
        found = data.split()
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def learn(self) -> None:
        """Measure the words numbered since the last call."""
        fresh = list(self.number)[self.known:]
        if not fresh:
            return
        self.known = len(self.number)
        text = [w.decode() for w in fresh]
        size = np.fromiter(map(len, text), np.int64, len(text))
        points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        script = _SCRIPT_AT[np.searchsorted(_STARTS, points, side="right") - 1]
        owner = np.repeat(np.arange(len(text)), size)
        letters = script >= 0
        counts = np.bincount(owner[letters] * len(SCRIPTS) + script[letters],
                             minlength=len(text) * len(SCRIPTS))
        symbol = np.isin(points, np.frombuffer(SYMBOLS, np.uint8))
        self.chars = np.concatenate([self.chars, size])
        self.symbols = np.concatenate(
            [self.symbols, np.bincount(owner[symbol], minlength=len(text))])
        self.scripts = np.concatenate(
            [self.scripts, counts.reshape(len(text), -1).astype(np.int32)])
        for k, vocab in enumerate(self.vocabularies):
            ids = vocab.encode(text)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lens.sum()))
            self.tokens[k] = np.concatenate([self.tokens[k], flat])
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(lens)])

    def measures(self, number: np.ndarray, times: np.ndarray) -> list[tuple]:
        """(characters per token, byte share, bits) by vocabulary, of a text
        that holds the distinct words ``number`` that many ``times``."""
        out = []
        chars = float((self.chars[number] * times).sum())
        for vocab, tokens, ends in zip(self.vocabularies, self.tokens, self.ends):
            begin, size = ends[number], ends[number + 1] - ends[number]
            at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
            used, back = np.unique(tokens[at], return_inverse=True)
            count = np.bincount(back, weights=np.repeat(times, size))
            total = count.sum()
            if not total:
                out.append((None, None, None))
                continue
            share = count / total
            out.append((chars / total, float(count[vocab.is_byte[used]].sum() / total),
                        float(-(share * np.log2(share)).sum())))
        return out


def repeated_words(number: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(number) < 4:
        return 0
    _, pair = np.unique((number[:-1] << 31) | number[1:], return_inverse=True)
    _, back, count = np.unique((pair[:-1] << 31) | number[2:], return_inverse=True,
                               return_counts=True)
    again = count[back] > 1
    inside = np.zeros(len(number), bool)
    for k in range(3):
        inside[k:len(number) - 2 + k] |= again
    return int(inside.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if data.count(b"\n") == 0:
        return 0
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def pieces(data: bytes):
    """The text in pieces of about ``PIECE`` bytes, cut at white space."""
    start = 0
    while len(data) - start > PIECE:
        inside = words.IS_WORD[np.frombuffer(data, np.uint8, offset=start + PIECE)]
        after = int(np.argmin(inside))
        if inside[after]:  # one word up to the end
            break
        yield data[start:start + PIECE + after]
        start += PIECE + after
    yield data[start:] if start else data


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _schema(n: int) -> str:
    longs = ", ".join(f"{c} long" for c in _NAMES)
    measured = ", ".join(f"chars_{k} double, bytes_{k} double, bits_{k} double" for k in range(n))
    return f"doc_id long, lang string, text_hash long, {longs}, script string, {measured}"


def _measure(shipped):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lexicon = Lexicon([_built(*v) for v in shipped.value])
        n = len(lexicon.vocabularies)
        kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * len(_NAMES), pa.string(),
                 *[pa.float64()] * (3 * n)]
        names = [c.split()[0] for c in _schema(n).split(", ")]
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            ids, langs, hashes = (batch.column(c).to_pylist() for c in ("_id", "_lang", "_hash"))
            for a, b in words.chunks(texts, PIECE):
                rows = []
                read = []
                for text in texts[a:b]:
                    parts = []
                    for part in pieces(text):
                        parts.append(lexicon.numbers(part))
                        if len(text) > PIECE:
                            lexicon.learn()
                    read.append(np.concatenate(parts))
                lexicon.learn()
                for k, (text, number) in enumerate(zip(texts[a:b], read), a):
                    used, times = np.unique(number, return_counts=True)
                    scripts = (lexicon.scripts[used] * times[:, None]).sum(axis=0)
                    script = SCRIPTS[int(np.argmax(scripts))] if scripts.any() else "none"
                    rows.append((ids[k], langs[k], hashes[k], len(number),
                                 int((lexicon.chars[used] * times).sum()),
                                 int((lexicon.symbols[used] * times).sum()),
                                 repeated_lines(text), repeated_words(number), script,
                                 *[m for v in lexicon.measures(used, times) for m in v]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                if lexicon.known > KEPT_WORDS:
                    lexicon.clear()
        lexicon = None
        words.release()
    return run


def measure(docs: DataFrame, vocabularies: list, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str | None = "lang") -> DataFrame:
    """One row per document: the base counts, the main script and the
    measures ``chars_k, bytes_k, bits_k`` of vocabulary ``k``."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), lang.alias("_lang"),
                       F.xxhash64(text).alias("_hash"), text.alias("_text"))
    sent = spark.sparkContext.broadcast(vocabularies)
    return rows.mapInArrow(_measure(sent), _schema(len(vocabularies)))


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words")))


_GROUP = ("_group", "_class")


def _grouped(measured: DataFrame) -> DataFrame:
    size = F.floor(F.log2(F.greatest("n_words", F.lit(1))) / 2).cast("int")
    return measured.withColumns({"_group": F.coalesce("lang", "script"), "_class": size})


def fit_bands(measured: DataFrame, n: int) -> DataFrame:
    """``_group, _class, low_.., high_..`` of each measure, for groups of at
    least ``LEAST_TEXTS`` distinct texts."""
    names = [f"{m}_{k}" for k in range(n) for m in SLACK]
    texts = (_grouped(measured.filter(~base_failed()))
             .dropDuplicates([*_GROUP, "text_hash", "n_words", "word_chars"]))
    cells = (texts.select(*_GROUP, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_measure"), F.round(F.col(c) / BIN).cast("long").alias("_bin"))
        for c in names])).alias("_m"))
        .groupBy(*_GROUP, "_m._measure", "_m._bin").agg(F.count(F.lit(1)).alias("_n")))
    key = [*_GROUP, "_measure"]
    up = Window.partitionBy(*key).orderBy("_bin")
    whole = Window.partitionBy(*key)
    ranked = cells.select(*key, "_bin", F.sum("_n").over(up).alias("_upto"),
                          F.sum("_n").over(whole).alias("_all"))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.col("_all") * share, F.col("_bin"))) * F.lit(BIN)

    marks = (ranked.groupBy(*key).agg(F.first("_all").alias("_all"), at(0.25).alias("_q1"),
                                      at(0.5).alias("_q2"), at(0.75).alias("_q3"))
             .filter(F.col("_all") >= LEAST_TEXTS))
    kind = F.split("_measure", "_")[0]
    least = reduce(lambda rest, m: F.when(kind == m, F.lit(SLACK[m]) * (
        F.lit(1.0) if m == "bytes" else F.col("_q2"))).otherwise(rest), SLACK, F.lit(0.0))
    reach = F.greatest(REACH * (F.col("_q3") - F.col("_q1")), least)
    return (marks.withColumns({"_low": F.col("_q1") - reach, "_high": F.col("_q3") + reach})
            .groupBy(*_GROUP).pivot("_measure", names)
            .agg(F.first("_low").alias("low"), F.first("_high").alias("high")))


def _wide(place: int) -> Column:
    return reduce(lambda rest, s: F.when(F.col("script") == s, F.lit(WIDE[s][place])).otherwise(rest),
                  WIDE, F.lit(WIDE_OTHER[place]))


def judged(measured: DataFrame, bands: DataFrame, n: int) -> DataFrame:
    """``measured`` with ``base_failed, kept, broken`` (the measures outside
    their band)."""
    rows = _grouped(measured).join(broadcast_if_small(bands), list(_GROUP), "left")
    broken = []
    for k in range(n):
        for kind, (least, most) in {"chars": (0, 1), "bytes": (None, 2), "bits": (3, None)}.items():
            name = f"{kind}_{k}"
            out = F.lit(False)
            if least is not None:
                out |= F.col(name) < F.coalesce(F.col(f"{name}_low"), _wide(least))
            if most is not None:
                out |= F.col(name) > F.coalesce(F.col(f"{name}_high"), _wide(most))
            broken.append(F.when(out, F.lit(name)))
    rows = rows.withColumns({"base_failed": base_failed(),
                             "broken": F.array_compact(F.array(*broken))})
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    return rows.drop(*_GROUP, *[f"{m}_{k}_{e}" for m in SLACK for k in range(n)
                                for e in ("low", "high")])


def quality_rules(docs: DataFrame, paths: list[str], pattern: str, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document: the base counts, the measures and the verdict."""
    vocabularies = [vocabulary(p, pattern) for p in paths]
    n = len(vocabularies)
    measured = saved(measure(docs, vocabularies, id_col, text_col, lang_col), "fertility")
    bands = saved(fit_bands(measured, n), "fertility-bands")
    return judged(measured, bands, n).drop("text_hash")
