"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar says how a text is cut from left to right.  It is translated to pairs of neighbouring classes
between which one unit ends and the next begins, and those to one regular expression of zero width: a
lookbehind for the class before the boundary and a lookahead for the class after it.  Splitting at it keeps
every piece, so that the pieces joined are the text.

Defined results: a null text counts as empty; an empty text has no unit, though a split returns one empty
piece, and stays plain, as does a text that holds one of the markers itself; a null doc_id hashes as nothing
after "1:"; rows that repeat are cut alike; other columns of the input are ignored by fill_in_middle().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def each() -> list[tuple[str, str]]:
    """Every code point is a unit."""
    return [(".", ".")]


def runs(*classes: str) -> list[tuple[str, str]]:
    """Units are runs of one class; the classes share no code point and cover all."""
    return [(a, b) for a in classes for b in classes if a != b]


def closed_by(end: str) -> list[tuple[str, str]]:
    """Each unit ends after a code point of this class, the last one at the end of the text."""
    return [(end, ".")]


GRAMMARS = {"chars": each(), "words": runs(SPACE, WORD), "lines": closed_by(r"\n")}


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width pattern that matches where two units meet, whatever the code points are."""
    return "(?s)" + "|".join(f"(?<={a})(?={b})" for a, b in grammar)


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of a text, in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draw(doc_id: Column, k: int) -> Column:
    """The k-th number, from 1, of a document: eight hexadecimal digits of a hash of its id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = "chars", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output for every row.

    Of h1 to h4, the document's numbers, the first two cut the text, plain_from percent by the third are
    transformed at all, and spm_below percent of those by the fourth put the suffix first.  One narrow pass."""
    text, parts, lo, hi = unused(docs, "body", "parts", "lo", "hi")
    n = F.size(parts)
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias(text))
    cut = cut.select("*", units(F.col(text), GRAMMARS[unit]).alias(parts))
    ends = [draw(F.col("doc_id"), k) % (n + 1) for k in (1, 2)]
    cut = cut.select("*", F.least(*ends).cast("int").alias(lo), F.greatest(*ends).cast("int").alias(hi))
    plain = (F.col(text) == "") | F.col(text).rlike(MARKER) | (draw(F.col("doc_id"), 3) % 100 >= plain_from)
    form = F.when(plain, "plain").when(draw(F.col("doc_id"), 4) % 100 < spm_below, "spm").otherwise("psm")
    piece = lambda start, count: F.array_join(F.slice(parts, start, count), "")
    cut = cut.select(
        "doc_id", text, n.cast("long").alias("n"), form.alias("form"),
        *[F.when(form != "plain", p).alias(c) for p, c in ((piece(F.lit(1), F.col(lo)), "prefix"), (piece(F.col(lo) + 1, F.col(hi) - F.col(lo)), "middle"), (piece(F.col(hi) + 1, n - F.col(hi)), "suffix"))],
    )
    psm = F.concat(F.lit(PREFIX), F.col("prefix"), F.lit(SUFFIX), F.col("suffix"), F.lit(MIDDLE), F.col("middle"))
    spm = F.concat(F.lit(SUFFIX), F.col("suffix"), F.lit(PREFIX), F.col("prefix"), F.lit(MIDDLE), F.col("middle"))
    return cut.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col(text)).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: no piece holds a marker, so the three markers part it."""
    p = F.split(output, MARKER, -1)
    return F.when(form == "psm", F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))).when(form == "spm", F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1)))).otherwise(output)
