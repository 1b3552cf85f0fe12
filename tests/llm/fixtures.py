"""A small awkward table: nulls, blanks, copies, near copies, repeated ids and rows, a long text, clashing column names."""

from __future__ import annotations

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key string, class string, band long, row long, digest string, "
          "shard int, size long, place double, spans string, labelled long, toxic int, margin double, u long, v long, n long")
_rng = random.Random(7)
_SYLLABLES = "ba re ti on ed mo lu shi ka pe".split()


def word() -> str:
    return "".join(_rng.choice(_SYLLABLES) for _ in range(_rng.randint(1, 4)))


def prose(n: int) -> str:
    return " ".join(word() for _ in range(n))


def edited(text: str, every: int) -> str:
    return " ".join(word() if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def texts() -> list[tuple[int | None, str | None]]:
    base, passage, long = prose(120), prose(60), prose(9000)
    out: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, base.replace(" ", " \n\t")), (4, edited(base, 40)), (5, edited(base, 60)), (6, edited(base, 12)),
        (7, None), (8, ""), (9, " \t\n "), (10, "one"), (11, "ONE"), (12, "two words"), (13, prose(30) + " " + passage), (14, passage + " " + prose(30)),
        (15, prose(10) + " " + passage + " " + prose(10)), (16, long), (17, long), (18, "x" * 5000), (19, "ab" * 400), (None, base), (None, prose(50)), (None, None),
        (20, "日本語のテキスト " * 60), (21, "É à ü " + prose(20)), (22, prose(5)), (23, "a b c d e"), (23, "a b c d e"), (23, "another text of the same id"),
        (24, "mail me at some.one+x@mail-1.example.com or 10.0.0.255, card 4111 1111 1111 1111, call +44 (20) 7946-0958 now"),
        (25, "IBAN GB82 WEST 1234 5698 7654 32 and phone 020 7946 0958; not 4111 1111 1111 1112 nor 300.1.1.1"),
    ]
    out += [(100 + i, prose(_rng.randint(3, 80))) for i in range(40)]
    out += [(200 + i, edited(base, 100 + i)) for i in range(12)]
    out.append(out[-1])
    return out


ROWS = texts()


def frame(spark, rows=None):
    made = [(i, t, None, "src0", None, "k", "c", 1, 2, "d", 3, 4, 0.5, "s", 5, 1, 0.1, 6, 7, 8) for i, t in (ROWS if rows is None else rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)
