"""One form for texts that look the same.

1. Distinct texts meet in one partition each, by a digest; texts of ASCII characters are their own
   form and go no further.
2. The texts are exploded to positioned code points (what is ASCII stays in runs) and joined with
   the mapping of decompositions and look-alikes, a table over the characters of Unicode that have
   one. The table is bounded by the character set, so it is broadcast.
3. The pieces come back in the order of their positions, block by block, then text by text.
   Combining marks are ordered by class and composed with their base.

The explode, the join and both aggregations keep the partitioning of the digests, so the texts are
shuffled once. A text is put together in blocks of BLOCK pieces, however long it is.

What the form does not show, because a reader does not see it: the width of a character or of a
single space, invisible characters, the composition of an accent, joined letters, and which of
several letters or signs of one shape is used. Case, digits, raised digits, accents, punctuation,
line breaks and the number of spaces stay.

Letters of one shape: the list below for the scripts this corpus is written in, and the Unicode
confusables of the JVM's ICU for all other scripts, as far as no two letters of a script would
become one. Plain and typewriter letters of mathematics are letters, bold and slanted ones are seen.

Defined results: null stays null and '' stays ''; a text of ASCII characters is its own form; the
form of a form is itself. A zero width joiner between two pictographs is seen (it makes another
picture) and stays. Rows with a null key have a form and take no part in pairs and classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import Scratch

# Letters and signs drawn like another one, each pair as "look-alike, plain form".
LOOKALIKES = """
аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs уy үy хx ԝw ѵv ցg
АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ҮY ԚQ ԜW ԌG ӀI ѴV
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ ϜF οo νv ϲc ϳj
ɑa ɡg ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs
օo ՕO սu ՍU ոn հh ՏS ԼL
ӕæ ӔÆ әə ӘƏ ÐĐ ƉĐ
ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏃZ ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB
ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU
‐- ‑- ˗- ⁃- −– ‒– ―— ʼ’ ʻ‘ ∕/ ⁄/ ∶: ꞉: ‚, ․. ∗* ∣| ǀ| ǃ! ∼~ ∙· ⋅· ‧· ∆Δ ∑Σ ∏Π ヘへ
"""

_ALIKE = {pair[0]: pair[1] for pair in LOOKALIKES.split()}
_JOINER = "\u200d"
#: Pieces of a text that are put together at once, and documents of a class that meet all others in one task.
BLOCK, CLASS_ROWS = 4096, 2000
#: Formatting tags of compatibility decompositions that change width, joining or line breaking only.
_SHAPE_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>")
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2065}


_PLAIN_MATHS = re.compile("MATHEMATICAL (?:SANS-SERIF|MONOSPACE) (?:CAPITAL|SMALL|DIGIT)")
#: Scripts whose look-alikes are listed above: their other letters are told apart by whoever reads them.
_READ = ("LATIN", "GREEK", "CYRILLIC", "CJK", "HANGUL", "HIRAGANA", "ARABIC", "HEBREW", "THAI", "DEVANAGARI")


def fold(char: str, alike: dict[str, str] = _ALIKE) -> str:
    """The decomposed plain form of one character; '' if it is not seen."""
    cp, cat = ord(char), unicodedata.category(char)
    if cat == "Cf" or cp in _FILLERS or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0000 <= cp <= 0xE0FFF:
        return ""
    if cat == "Zs":
        return " "
    if cp in (0x2028, 0x2029, 0x85):
        return "\n"
    found = unicodedata.decomposition(char)
    if _PLAIN_MATHS.match(unicodedata.name(char, "")):
        return unicodedata.normalize("NFKC", char)
    if found.startswith("<"):
        tag, *parts = found.split()
        to = "".join(chr(int(p, 16)) for p in parts)
        name = unicodedata.name(char, "")
        plain = tag in _SHAPE_TAGS and not to.startswith(" ")
        if tag == "<compat>":  # joined letters, numerals made of letters, signs kept for old codes
            joined = cat.startswith("L") and len(to) > 1 and all(unicodedata.category(c)[0] in "LM" for c in to) and "LONG S" not in name
            plain = joined or cat == "Nl" or cp == 0xB5 or "RADICAL" in name
        if plain and len(to) <= 4:
            return "".join(fold(c, alike) for c in to)
        return alike.get(char, char)
    out = unicodedata.normalize("NFD", char)
    if out == char:
        return alike.get(char, char)
    return "".join(alike.get(c, c) for c in out)


def _script(char: str) -> str:
    return unicodedata.name(char, "?").split()[0]


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of scripts that are not listed, each with the letter it is drawn like, after ICU.

    A letter counts if its skeleton is one letter of another script, and no other letter of its own
    script and case has the same one. The skeleton "l" of a capital is an "I".
    """
    builder = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder()
    letters = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "L" and not unicodedata.decomposition(c)]
    letters = [c for c in letters if _script(c) not in _READ and c not in _ALIKE]
    skeletons = builder.build().getSkeleton("\n".join(letters)).split("\n")
    found: dict[tuple[str, str, str], list[str]] = {}
    for c, k in zip(letters, skeletons):
        same_case = k == "l" and unicodedata.category(c) in ("Lu", "Lo")
        to = "I" if same_case else k
        if len(to) == 1 and unicodedata.category(to)[0] == "L" and _script(to) != _script(c) and (to.isascii() or _script(c) == "KATAKANA"):
            found.setdefault((_script(c), unicodedata.category(c), to), []).append(c)
    listed = Counter((_script(a), unicodedata.category(a), b) for a, b in _ALIKE.items())
    return {own[0]: key[2] for key, own in found.items() if len(own) == 1 and not listed[key]}


_CHARS: dict[str, str] = {}


def mapped_characters(spark: SparkSession) -> dict[str, str]:
    """Every character with a form of its own, and that form. Composed letters that stay are left to composition."""
    if not _CHARS:
        alike = {**_ALIKE, **confusable_letters(spark)}
        for cp in range(0x80, 0x110000):
            c = chr(cp)
            if c == _JOINER or 0xAC00 <= cp <= 0xD7A3 or unicodedata.category(c) in ("Cs", "Co") or (cp > 0x3FFFF and not 0xE0000 <= cp <= 0xE0FFF):
                continue
            to = fold(c, alike)
            if to != c and unicodedata.normalize("NFC", to) != c:
                _CHARS[c] = to
    return _CHARS


def mapping(spark: SparkSession) -> DataFrame:
    """(q_char, q_to) of ``mapped_characters``: at most one row per character of Unicode."""
    chars = mapped_characters(spark)
    return spark.createDataFrame(pa.table({"q_char": list(chars), "q_to": list(chars.values())}))


_JOINERS = re.compile(f"({_JOINER}+)")


def _picture(char: str) -> bool:
    return unicodedata.category(char) in ("So", "Sk") if char else False


def finished(text: str) -> str:
    """Mapped code points as a form: marks ordered and composed, joiners only between pictographs."""
    if _JOINER in text:
        parts = _JOINERS.split(text)
        for i in range(1, len(parts), 2):
            if not (_picture(parts[i - 1][-1:]) and _picture(parts[i + 1][:1])):
                parts[i] = ""
        text = "".join(parts)
    return unicodedata.normalize("NFC", text)


def canonical_texts(texts: list[str | None], alike: dict[str, str] = _ALIKE) -> list[str | None]:
    """The forms of single texts, character by character: what the columns are tested against."""
    return [t if not t or t.isascii() else finished("".join(c if c == _JOINER else fold(c, alike) for c in t)) for t in texts]


def _wide(text: str) -> Column:
    return F.col(text).rlike(r"[^\x00-\x7F]")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def forms(df: DataFrame, text: str = "text") -> DataFrame:
    """(own, form): digest and form of every distinct text that is not all ASCII."""
    rows = df.where(_wide(text)).select(_digest(F.col(text)).alias("own"), F.col(text).alias("q_text"))
    rows = rows.groupBy("own").agg(F.first("q_text").alias("q_text"))
    pieces = F.regexp_extract_all("q_text", F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    points = rows.select("own", F.posexplode(pieces).alias("q_pos", "q_piece"))
    table = F.broadcast(mapping(df.sparkSession))
    points = points.join(table, F.col("q_piece") == F.col("q_char"), "left")
    points = points.select("own", F.floor(F.col("q_pos") / BLOCK).cast("int").alias("q_block"), "q_pos", F.coalesce("q_to", "q_piece").alias("q_piece"))
    ordered = lambda at, what: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, what))), lambda x: x[what]), "")
    blocks = points.groupBy("own", "q_block").agg(ordered("q_pos", "q_piece").alias("q_part"))
    whole = blocks.groupBy("own").agg(ordered("q_block", "q_part").alias("form"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([finished(t) for t in b.column(1).to_pylist()], pa.string())], ["own", "form"])

    return whole.mapInArrow(finish, "own binary, form string")


def canonical_column(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): the consistent form of each text."""
    rows = df.select(F.col(key), F.col(text).alias("q_text"))
    plain = rows.where(F.col("q_text").isNull() | ~_wide("q_text")).select(key, F.col("q_text").alias("text"))
    wide = rows.where(_wide("q_text")).select(key, _digest(F.col("q_text")).alias("q_own"))
    found = forms(df, text)
    return plain.unionByName(wide.join(found, F.col("q_own") == F.col("own")).select(key, F.col("form").alias("text")))


#: A character that is no white space, as ``str.strip`` has it.
_SEEN = r"[^\s\x1C-\x1F\x85\p{Z}]"


def digests(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, form, own): digests of the form and of the text itself; blank texts have no row."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).rlike(_SEEN)).select(F.col(key), _digest(F.col(text)).alias("own"), _wide(text).alias("q_wide"))
    found = forms(df, text).select(F.col("own").alias("q_own"), F.when(F.col("form").rlike(_SEEN), _digest(F.col("form"))).alias("q_form"))
    plain = rows.where(~F.col("q_wide")).select(key, F.col("own").alias("form"), "own")
    wide = rows.where("q_wide").join(found, F.col("own") == F.col("q_own")).where(F.col("q_form").isNotNull())
    return plain.unionByName(wide.select(key, F.col("q_form").alias("form"), "own"))


def classes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, class_id, n_links): per document the smallest key with its form, and how many have its form in other characters.

    One row per key and text. Blank texts have none. A class is never gathered: it is counted per
    form and per text.
    """
    d = Scratch(df.sparkSession, "lookalike").save(digests(df, key, text).distinct(), "digests")
    texts = d.groupBy("form", "own").agg(F.count("*").alias("q_same"), F.min(key).alias("q_first"))
    whole = texts.groupBy(F.col("form").alias("q_form")).agg(F.sum("q_same").alias("q_all"), F.min("q_first").alias("class_id"))
    texts = texts.join(whole, F.col("form") == F.col("q_form")).select(F.col("own").alias("q_own"), F.col("form").alias("q_f"), "class_id", (F.col("q_all") - F.col("q_same")).alias("n_links"))
    return d.join(texts, (F.col("own") == F.col("q_own")) & (F.col("form") == F.col("q_f"))).select(key, "class_id", "n_links")


def same_to_a_reader(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(doc_a, doc_b): pairs whose texts differ in code points and not in their form.

    Only digests are shuffled. Forms that have one text only, however many copies of it there
    are, are left out before documents meet, so copies alone never form pairs. A class larger than
    CLASS_ROWS is cut in parts of that size; each part meets the class in a task of its own.
    """
    d = Scratch(df.sparkSession, "lookalike").save(digests(df, key, text).distinct(), "digests")
    mixed = d.groupBy("form").agg(F.min("own").alias("q_low"), F.max("own").alias("q_high"), F.count("*").alias("q_n"))
    mixed = mixed.where(F.col("q_low") != F.col("q_high")).select(F.col("form").alias("q_form"), F.ceil(F.col("q_n") / CLASS_ROWS).cast("int").alias("q_parts"))
    rows = d.join(mixed, F.col("form") == F.col("q_form"))
    a = rows.select(F.col(key).alias("doc_a"), F.col("form").alias("q_fa"), F.col("own").alias("q_oa"), F.pmod(F.xxhash64(key), F.col("q_parts")).cast("int").alias("q_pa"))
    b = rows.select(F.col(key).alias("doc_b"), F.col("form").alias("q_fb"), F.col("own").alias("q_ob"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_pb"))
    on = (F.col("q_fa") == F.col("q_fb")) & (F.col("q_pa") == F.col("q_pb"))
    pairs = a.join(b, on & (F.col("doc_a") < F.col("doc_b")) & (F.col("q_oa") != F.col("q_ob")))
    return pairs.select("doc_a", "doc_b").distinct()
