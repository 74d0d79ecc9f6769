"""Attempts to hide text: look-alike letters, invisible characters, hidden or tiny DOCX text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import starts, utf16_length, utf16_units
from lexloom.lexicon import CYRILLIC_TO_LATIN, LATIN_TO_CYRILLIC, ZERO_WIDTH

# Fixed value: half points below which a font is tiny; the patterns of docx_flags are fixed too.
TINY_HALF_POINTS = 12
_CYRILLIC, _LATIN = r"[\x{0400}-\x{04FF}]", "[A-Za-z]"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def homoglyphs(docs: DataFrame) -> DataFrame:
    """doc_id, position, char, looks_like, word: letters of the other script in words that hold at
    least one of the document's main script. Positions: UTF-16 units to the word, then letters."""
    text = F.coalesce("text", F.lit(""))
    n_cyr, n_lat = F.regexp_count(text, F.lit(_CYRILLIC)), F.regexp_count(text, F.lit(_LATIN))
    # a letter of the other script needs both scripts: other texts go no further
    base = docs.filter(text.rlike(_CYRILLIC) & text.rlike(_LATIN)).select("doc_id", text.alias("text"), n_cyr.alias("c"), n_lat.alias("l"))
    base = base.withColumn("cyrillic", F.col("c") * 2 >= F.col("c") + F.col("l"))
    # words and what stands between them, in turn: positions are sums of lengths
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    gaps = F.split("text", r"\p{L}+")
    units = lambda parts: F.transform(parts, lambda x: utf16_length(x).cast("long"))
    cut = base.select("doc_id", "cyrillic", gaps.alias("gaps"), words.alias("words")).filter(F.size("words") > 0)
    cut = cut.withColumn("starts", starts(units(F.slice("gaps", F.lit(1), F.size("words"))), units(F.col("words"))))
    placed = cut.select("doc_id", "cyrillic", F.explode(F.arrays_zip("starts", "words")).alias("w")).select("doc_id", "cyrillic", F.col("w.words").alias("word"), F.col("w.starts").alias("start"))
    main = F.when(F.col("cyrillic"), F.col("word").rlike(_CYRILLIC)).otherwise(F.col("word").rlike(_LATIN))
    chars = placed.filter(main).select("doc_id", "cyrillic", "word", "start", F.posexplode(F.split("word", "")).alias("i", "char"))
    like = F.when(F.col("cyrillic"), F.try_element_at(_table(LATIN_TO_CYRILLIC), F.col("char"))).otherwise(F.try_element_at(_table(CYRILLIC_TO_LATIN), F.col("char")))
    return chars.withColumn("looks_like", like).filter("looks_like is not null").select("doc_id", (F.col("start") + F.col("i")).alias("position"), "char", "looks_like", "word")


def zero_width(docs: DataFrame) -> DataFrame:
    """doc_id, position (UTF-16), label `U+XXXX` of every invisible character."""
    text = F.coalesce("text", F.lit(""))
    hit = docs.filter(text.rlike("[" + "".join(ZERO_WIDTH) + "]"))
    each = hit.select("doc_id", F.posexplode(utf16_units(F.col("text"))).alias("position", "code"))
    codes = [ord(c) for c in ZERO_WIDTH]
    return each.filter(F.col("code").isin(*codes)).select("doc_id", F.col("position").cast("long").alias("position"), F.concat(F.lit("U+"), F.lpad(F.hex("code"), 4, "0")).alias("label"))


def docx_flags(xml: Column) -> Column:
    """An array of (type, kind, count, least points) from word/document.xml."""
    vanish = F.regexp_count(xml, F.lit(r"<w:vanish\s*/>"))
    white = F.regexp_count(xml, F.lit(r'(?i)<w:color[^>]*w:val="FFFFFF"'))
    sizes = F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r'<w:sz\s+w:val="(\d+)"'), 1), lambda s: s.cast("long")), lambda n: (n > 0) & (n < TINY_HALF_POINTS))
    none = F.lit(None).cast("double")

    def flag(kind: str, name: str, n: Column, points: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("kind"), n.cast("long").alias("count"), points.alias("least_points"))

    return F.filter(F.array(flag("HIDDEN_TEXT", "vanish", vanish, none), flag("HIDDEN_TEXT", "white", white, none),
                            flag("TINY_FONT", "size", F.size(sizes), F.array_min(sizes) / F.lit(2.0))), lambda f: f["count"] > 0)


def docx_findings(docs: DataFrame) -> DataFrame:
    """docs: doc_id, xml. A row for each finding; null xml has none."""
    return docs.select("doc_id", F.explode(docx_flags(F.coalesce("xml", F.lit("")))).alias("f")).select("doc_id", "f.*")
