"""Benchmark decontamination by pigeonhole edit matching.

A test item may be found with up to ``len * ERROR`` edits. Cut into one piece more than that, at least one piece must stand in
the document unchanged, whatever the edits are. One Aho-Corasick pass finds all exact piece hits; the window
that a hit points to is verified with Myers' bit-parallel edit distance over the whole item. Both sides are compared in lower
case with single spaces.

The items go to the workers in blocks of about BLOCK_BYTES of text, as many as the benchmark needs, so what is sent has a
bound whatever the benchmark's size. Documents are matched where they are, with no shuffle.

Cases: null and empty documents match nothing; null, empty and blank items are passed over. An item's first confirmed place in a document is
reported. Items that repeat an id or a text are all matched. An empty document table gives no rows, an empty benchmark
no matches. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import held, narrow

ERROR = 0.05
BLOCK_BYTES = 8 << 20

MATCH = "array<struct<item_id: long, distance: int, start: int, end: int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces that make up the item, of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(low, item[low:high]) for low, high in zip(cuts, cuts[1:])]


def letters(item: str) -> dict[str, int]:
    """For each character the bits of the places where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(places: dict[str, int], size: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``text`` where the item ends, or None above the budget (Myers, 1999)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, None
    for at, c in enumerate(text):
        same = places.get(c, 0)
        cross = same | down
        level = (((same & up) + up) ^ up) | same
        plus, minus = (down | ~(level | up)) & full, up & level
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(cross | plus)) & full, plus & cross
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Piece automaton and items of one block."""

    def __init__(self, items: list[tuple[int | None, str]], error: float) -> None:
        import ahocorasick

        self.items, owners = [], {}
        for item_id, text in items:
            item = plain(text or "")
            if item:
                budget = int(len(item) * error)
                for offset, piece in pieces(item, budget):
                    owners.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, item, budget, letters(item)))
        self.automaton = ahocorasick.Automaton()
        for piece, owning in owners.items():
            self.automaton.add_word(piece, (len(piece), owning))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[dict]:
        text = plain(text or "")
        if not self.items or not text:
            return []
        found: dict[int, dict] = {}
        tried: dict[int, int] = {}
        for last, (length, owning) in self.automaton.iter(text):
            for number, offset in owning:
                if number in found:
                    continue
                item_id, item, budget, places = self.items[number]
                start = last + 1 - length - offset
                if tried.get(number) == start:  # the same alignment by another piece
                    continue
                tried[number] = start
                low = max(0, start - budget)
                window = text[low : start + len(item) + budget]
                hit = best_end(places, len(item), window, budget)
                if hit:
                    found[number] = {"item_id": item_id, "distance": hit[0], "start": max(0, low + hit[1] - len(item)), "end": low + hit[1]}
        return [found[n] for n in sorted(found)]


def _matcher(items: list[tuple[int | None, str]], error: float) -> Matcher:
    return held(("matcher", len(items), hash(tuple(items)), error), lambda: Matcher(items, error))


def _block_matches(text: Column, items: list[tuple[int | None, str]], error: float) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = _matcher(items, error).find
        for batch in batches:
            yield pa.array([find(t.as_py()) for t in batch], _MATCH)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, MATCH)(text)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``size`` bytes, one after the other."""
    items = benchmark.select(ref(id_col).cast("long").alias("item_id"), ref(text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // size
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error: float = ERROR) -> Column:
    """A column for ``docs``: the items found in each text."""
    found = [_block_matches(F.coalesce(ref(text_col), F.lit("")), block, error) for block in blocks(benchmark)]
    return found[0] if len(found) == 1 else F.concat(*found)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: float = ERROR) -> DataFrame:
    """doc_id, matches (item_id, distance, start, end in the plain text), n_items and contaminated, one row for each row of ``docs``."""
    texts = narrow(docs, id_col, text_col)
    found = texts.select("doc_id", matches(texts, benchmark, error=error).alias("matches"))
    return found.select("doc_id", "matches", F.size("matches").cast("long").alias("n_items"), (F.size("matches") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error: float = ERROR) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    return docs.filter(F.size(matches(docs, benchmark, text_col, error)) == 0)
