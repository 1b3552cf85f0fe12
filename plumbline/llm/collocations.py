"""Phrase collocations from count streams in prefix and suffix order.

Phrases of up to ``longest`` words that occur at least ``least`` times in their language are counted exactly. Their counts make one stream that is kept in two orders:

- prefix order (by words from the first on): a phrase comes right behind its own prefixes, so one pass in lockstep with a stack of
  at most ``longest`` open phrases reads off the counts of all its left parts, and for each phrase the most frequent one that goes on to the right;
- suffix order (by words from the last on): the same pass gives the counts of all right parts and the most frequent extension to the left.

Both results, sorted by phrase, are merged: nothing is looked up by hash. A phrase scores as its weakest cut; one that occurs nearly only inside a
longer phrase is dropped. As counts fall with length, extensions by one word decide that.

How it runs: an order is cut into parts at sampled boundary phrases (the driver sees about 20 phrases a part of PART rows), so a first word that a
third of all phrases share is spread like any other. Prefixes of a boundary, fewer than ``longest`` each, are copied to the parts they reach into;
what copies learn of extensions is met again in the merge.

Counting runs in passes over the texts: words, pairs of frequent words, and longer phrases all of whose pairs are frequent, since a frequent phrase has
frequent parts. A pass knows the frequent parts by a bitmap of fixed size (BITS bits, hashed): a false hit there costs an idle count and no
error, whatever the size of the corpus. Tasks count sorted runs of RUN words each, and give whole words, never numbers, to the shuffle.

Cases: a null text has no words; a null language is ``und``. A phrase never spans pieces or documents. Repeated rows count as often as they occur. A
word or text of any length is read whole. A language without candidates, and an empty table, give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import mix, written

LONGEST = 4
LEAST = 30
KEPT = 2000
INSIDE = 80  # percent of a phrase's occurrences inside one longer phrase that make it a part of that one
BITS = 1 << 25
RUN = 1_000_000
RUN_BYTES = 16 << 20
WORDS = 300_000  # words a task remembers between runs
CHUNK = 1 << 20
PART = 200_000

_BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, phrase string, f long"


class Words(dict):
    """word -> number; 0 is the break between pieces. ``hashes`` holds the words' CRC-32 by number."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})
        self.hashes = array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.hashes.append(zlib.crc32(word))
        return number


def chunks(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes that end behind white space; a longer word stays whole."""
    low = 0
    while len(text) - low > CHUNK:
        cut = max(text.rfind(c, low, low + CHUNK) for c in (b" ", b"\t", b"\n"))
        if cut < 0:
            later = [at for at in (text.find(c, low + CHUNK) for c in (b" ", b"\t", b"\n")) if at >= 0]
            if not later:
                break
            cut = min(later)
        yield text[low : cut + 1]
        low = cut + 1
    yield text[low:]


def slots(lang: str, *hashes: np.ndarray) -> np.ndarray:
    """The bit of phrases, given the CRC-32 of their words in turn."""
    at = np.uint64(zlib.crc32(lang.encode()))
    for h in hashes:
        at = mix(at * _P + h + np.uint64(1)) if isinstance(at, np.ndarray) else mix(np.full(len(h), at, np.uint64) * _P + h + np.uint64(1))
    return at & np.uint64(BITS - 1)


def _hit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_run(ids: np.ndarray, starts: int, spell: pa.Array, hashes: np.ndarray, lang: str, sizes: list[int],
              of_words: np.ndarray | None, of_pairs: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of these sizes that begin before ``starts``, and their counts, each phrase once. Words are numbers in ``spell`` and ``hashes``."""
    if sizes == [1]:
        n = np.bincount(ids[:starts], minlength=len(spell))
        n[0] = 0
        found = np.flatnonzero(n)
        yield spell.take(pa.array(found)).cast(pa.string()), n[found]
        return
    good = _hit(of_words, slots(lang, hashes))
    good[0] = False
    padded = np.concatenate((ids, np.zeros(max(sizes), np.int64)))
    usable = good[padded]
    run = usable[:-1] & usable[1:]
    if of_pairs is not None:
        at = np.flatnonzero(run)
        run[at] = _hit(of_pairs, slots(lang, hashes[padded[at]], hashes[padded[at + 1]]))
    code, length, at = None, 1, None
    for size in sorted(sizes):
        while length < size:  # places whose first ``length + 1`` words are joined by good pairs
            if at is None:
                at = np.flatnonzero(run[: len(ids)])
                at = at[at < starts]
                code = padded[at]
            else:
                still = run[np.minimum(at + length - 1, len(run) - 1)] & (at + length < len(padded))
                at, code = at[still], code[still]
            code = np.unique(code, return_inverse=True)[1].astype(np.int64) * len(spell) + padded[np.minimum(at + length, len(padded) - 1)]
            length += 1
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        parts = [spell.take(pa.array(padded[at[first] + k])) for k in range(size)]
        yield pc.binary_join_element_wise(*parts, b" ").cast(pa.string()), n


def _counts(sizes: list[int], of_words: np.ndarray | None = None, of_pairs: np.ndarray | None = None):
    longest = max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: dict[str, list[np.ndarray]] = {}
        total = size = 0

        def flush(open_lang: str | None) -> Iterator[pa.RecordBatch]:
            nonlocal words, held, total, size
            spelled, rest = list(words), None
            spell, hashes = pa.array(spelled, pa.binary()), np.array(words.hashes, np.uint64)
            for lang, parts in held.items():
                ids = np.concatenate(parts)
                starts = len(ids)
                if lang == open_lang:  # the document goes on: its last places wait for the words behind them
                    starts = max(0, starts - (longest - 1))
                    rest = [spelled[i] for i in ids[starts:]]
                for phrases, n in count_run(ids, starts, spell, hashes, lang, sizes, of_words, of_pairs):
                    for low in range(0, len(n), 50_000):
                        part = n[low : low + 50_000]
                        yield pa.record_batch([pa.array([lang] * len(part), pa.string()), phrases.slice(low, len(part)), pa.array(part, pa.int64())], names=["lang", "phrase", "f"])
            held, total, size = {}, 0, 0
            if len(words) > WORDS:
                words = Words()
            if rest:
                held[open_lang] = [np.array([words[w] for w in rest], np.int64)]

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for chunk in chunks(text.as_py()):
                    tokens = chunk.translate(_TABLE).replace(_BREAK, b" \xff ").split()
                    held.setdefault(lang, []).append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
                    total, size = total + len(tokens), size + len(chunk)
                    if total >= RUN or size >= RUN_BYTES:
                        yield from flush(lang)
                held.setdefault(lang, []).append(np.zeros(1, np.int64))
        yield from flush(None)

    return run


def counted(texts: DataFrame, sizes: list[int], of_words: np.ndarray | None = None, of_pairs: np.ndarray | None = None) -> DataFrame:
    """lang, phrase and f (its occurrences) of the phrases of these sizes."""
    return texts.mapInArrow(_counts(sizes, of_words, of_pairs), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bitmap(phrases: DataFrame) -> np.ndarray:
    """BITS bits with those of the phrases (lang, phrase) set: 4 KB pieces made by tasks, BITS / 8 bytes in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [int(slots(lang, *(np.array([zlib.crc32(w)], np.uint64) for w in phrase.encode().split(b" ")))[0])
                  for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
            yield pa.record_batch([pa.array(at, pa.int64())], names=["at"])

    made = phrases.select("lang", "phrase").mapInArrow(run, "at long").selectExpr("bitmap_bucket_number(at + 1) AS piece", "bitmap_bit_position(at + 1) AS bit")
    out = np.zeros(BITS // 8, np.uint8)
    for r in made.groupBy("piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
        out[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def boundaries(stream: DataFrame, parts: int, total: int) -> list[tuple[str, tuple]]:
    """About evenly spaced (lang, key) that part the stream: every part's first place, but for the first part's."""
    every = max(1, total // (20 * parts))
    some = stream.filter(F.pmod(F.xxhash64("lang", "key"), F.lit(every)) == 0).select("lang", "key").collect() if parts > 1 else []
    found = sorted((r["lang"], tuple(r["key"])) for r in some)
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def _dealt(bounds: list[tuple[str, tuple]]):
    """Adds the part of each row, and copies of the prefixes of boundaries for the parts they reach into."""
    reach: dict[tuple[str, tuple], list[int]] = {}
    for at, (lang, key) in enumerate(bounds):
        for n in range(1, len(key)):
            reach.setdefault((lang, key[:n]), []).append(at + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, part, own = [], [], []
            for i, (lang, key) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist())):
                key = tuple(key)
                home = bisect_right(bounds, (lang, key))
                for p in [home, *(p for p in reach.get((lang, key), ()) if p != home)]:
                    take.append(i)
                    part.append(p)
                    own.append(p == home)
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part, pa.int32()), pa.array(own, pa.bool_())], names=[*batch.schema.names, "part", "own"])

    return run


_READ = "lang string, key array<string>, f long, counts array<long>, extension long"


def _in_lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part in order: each phrase with the counts of its prefixes and the greatest count of a phrase one word longer."""
    stack: list[list] = []  # open phrases: key, count, own, counts of prefixes, extension
    where: tuple | None = None
    out: list[tuple] = []
    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def close(row: list) -> None:
        key, f, own, counts, extension = row
        if len(key) > 1:
            out.append((where[1], key, f if own else None, counts if own else None, extension))

    def made() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 5
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "key", "f", "counts", "extension"])
        out.clear()
        return batch

    for batch in batches:
        for part, lang, key, f, own in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "key", "f", "own"))):
            if (part, lang) != where:
                while stack:
                    close(stack.pop())
                where = (part, lang)
            while stack and key[: len(stack[-1][0])] != stack[-1][0]:
                close(stack.pop())
            if stack and len(stack[-1][0]) == len(key) - 1:
                stack[-1][4] = max(stack[-1][4] or 0, f)
            stack.append([key, f, own, [row[1] for row in stack], None])
        yield made()
    while stack:
        close(stack.pop())
    yield made()


def read_in_order(stream: DataFrame, total: int, part_rows: int = PART) -> DataFrame:
    """``stream`` (lang, key, f) in the order of its keys, read by ``_in_lockstep``."""
    parts = max(1, -(-total // part_rows))
    bounds = boundaries(stream, parts, total)
    dealt = stream.mapInArrow(_dealt(bounds), "lang string, key array<string>, f long, part int, own boolean")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "lang", "key").mapInArrow(_in_lockstep, _READ)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, kept: int = KEPT,
                 inside: int = INSIDE, part_rows: int = PART) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of each language's best ``kept`` phrases."""
    texts = docs.select(F.coalesce(ref(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(ref(text_col), F.lit("")).cast("binary").alias("text"))
    words = written(counted(texts, [1]))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = [words.filter(F.col("f") >= least)]
    of_words = bitmap(frequent[0])
    pairs = written(counted(texts, [2], of_words).filter(F.col("f") >= least))
    frequent.append(pairs)
    if longest > 2:
        frequent.append(counted(texts, list(range(3, longest + 1)), of_words, bitmap(pairs)).filter(F.col("f") >= least))
    rows = frequent[0]
    for more in frequent[1:]:
        rows = rows.union(more)
    stream = written(rows.select("lang", F.split("phrase", " ").alias("key"), "f"))
    total = stream.count()
    left = read_in_order(stream, total, part_rows).select("lang", F.col("key").alias("words"), "f", F.col("counts").alias("left"), F.lit(None).cast("array<long>").alias("right"), "extension")
    backward = stream.select("lang", F.reverse("key").alias("key"), "f")
    right = read_in_order(backward, total, part_rows).select("lang", F.reverse("key").alias("words"), F.lit(None).cast("long").alias("f"), F.lit(None).cast("array<long>").alias("left"),
                                                             F.col("counts").alias("right"), "extension")
    merged = left.union(right).groupBy("lang", "words").agg(F.max("f").alias("a"), F.max("left").alias("left"), F.max("right").alias("right"), F.max("extension").alias("extension"))
    # products are taken in 38 decimal digits
    open_ = merged.filter(F.expr(f"extension IS NULL OR 100 * CAST(extension AS DECIMAL(20, 0)) < {int(inside)} * CAST(a AS DECIMAL(20, 0))"))
    cut = F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', CAST((2000000 * CAST(a AS DECIMAL(20, 0))) div (CAST(left[k - 1] AS DECIMAL(20, 0)) + CAST(right[size(words) - k - 1] AS DECIMAL(20, 0))) AS BIGINT),
        'k', k, 'l', left[k - 1], 'r', right[size(words) - k - 1])))""")
    scored = open_.select("lang", F.array_join("words", " ").alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= kept)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# The same rows in DuckDB.
SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))))) AS phrase FROM w
), f AS (
  SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, phrase HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), parts AS (
  SELECT lang, f, ws, unnest(range(1, len(ws) + 1)) AS i FROM f WHERE len(ws) > 1
), inner_parts AS (
  SELECT lang, f, len(ws) AS size, i, j, array_to_string(ws[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i, len(ws) + 1)) AS j FROM parts)
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM inner_parts WHERE j - i + 1 < size GROUP BY lang, phrase
), c AS (
  SELECT f.lang, f.phrase, f.f AS a, ws FROM f LEFT JOIN longer b ON b.lang = f.lang AND b.phrase = f.phrase WHERE len(ws) > 1 AND (b.f IS NULL OR 100 * b.f < 80 * f.f)
), cuts AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:len(c.ws)], ' ')
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
