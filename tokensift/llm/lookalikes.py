"""One consistent form for texts that look the same but differ in their characters.

1. Mapping, by built-in functions: invisible characters go, every blank becomes a space, full-width, half-width and font forms
   become ordinary letters, joined letters are taken apart, letters of other scripts that look like Latin ones become these.
   Nothing that can be seen changes: case, accents, punctuation and the number of blanks stay.  The forms of characters come
   from the character database and a table of shapes; the plan gets those of the characters that the column has, whose number
   is bounded by the character set.
2. The mapped values that are not plain ASCII are grouped under Unicode's accent- and case-sensitive collation, for which
   composed and combining accents are equal, and by the marks that the collation passes over; the distinct values alone are
   put into canonical order for it.  Every class gets one
   member as its canonical form: the catalogue's text if it has one, else a text that the mapping leaves as it is, else any;
   of equals the shortest, then the smallest.  The forms are joined back by value, values of very many rows in parts.
   Plain ASCII values are classes of their own: the collation never equates two of them, and the mapping leaves no
   invisible character that it would pass over.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokensift.llm.shipping import ship
from tokensift.llm.splitting import split_join
from tokensift.sources.tables import materialized

#: Letters and signs with the shape of a Latin letter or ASCII sign in common fonts, each before that; an own choice, by script.
LOOK_ALIKES = (
    "аa еe оo рp сc хx уy іi ѕs јj ԁd һh ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS ԚQ ԜW ӀI ҮY "
    "οo νv ρp κk ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    "ոn օo սu հh յj զq ՕO ՍU "
    "ᎠD ᎡR ᎢT Ꭵi ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲬX "
    "ɡg ɑa ‐- ‑- ․. ∕/ ∶: ꞉:"
)
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"
_FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Visible characters, marks aside, that the collation passes over.
_PASSED_OVER = "\u0640\u07fa\u180a\u1cd3\ufe73"
#: Code points that can have a form of their own: the basic plane without private ones, mathematical letters, tags.
_RANGES = (range(0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800), range(0xE0000, 0xE0200))
PLAIN = r"\A[\x20-\x7E]*\z"


@lru_cache(1)
def _tables() -> tuple[dict[int, str], dict[int, str]]:
    """Forms of single characters, from the character database, and look-alike letters."""
    forms = {}
    for point in (p for r in _RANGES for p in r):
        c = chr(point)
        kind = unicodedata.category(c)
        if c in _BLANKS or kind in ("Zs", "Zl", "Zp"):
            forms[point] = " "
        elif kind in ("Cf", "Cc") or c in _FILLERS or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            forms[point] = ""
        elif point >= 0x80:
            tag = unicodedata.decomposition(c).partition(" ")[0]
            to = unicodedata.normalize("NFKC", c)
            # letters joined in one character, and numerals that are letters; a single letter's variant looks different
            joined = tag == "<compat>" and all(unicodedata.category(x)[0] == "L" for x in to) and (len(to) > 1 or kind == "Nl")
            if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or c == "\u00b5" or joined and point != 0xFB05:
                forms[point] = to
    return forms, {ord(pair[0]): pair[1] for pair in LOOK_ALIKES.split()}


def lookalike_form(text: str) -> str:
    """The text with what cannot be told apart by eye made the same character."""
    forms, look = _tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(forms)).translate(look))


def _chars(texts: DataFrame) -> list[str]:
    """The characters outside plain ASCII of the one column of ``texts``; no more than there are."""
    c = F.col(texts.columns[0])
    rest = F.regexp_replace(F.make_valid_utf8(c), r"[\x20-\x7E]+", "")
    return [r["c"] for r in texts.where(~c.rlike(PLAIN)).select(F.explode(F.array_distinct(F.split(rest, ""))).alias("c")).where("c <> ''").distinct().collect()]


def _form(c: Column | str, chars: list[str]) -> Column:
    """The mapping of a text that has no other characters than ``chars`` and plain ASCII; accents may stay apart."""
    c = F.make_valid_utf8(c)
    forms = {x: to for x in sorted(chars) if (to := lookalike_form(x)) != x}
    single = {x: to for x, to in forms.items() if len(to) == 1}
    gone = [x for x, to in forms.items() if not to]
    if single or gone:
        c = F.translate(c, "".join([*single, *gone]), "".join(single.values()))
    for x, to in forms.items():
        if len(to) > 1:
            c = F.replace(c, F.lit(x), F.lit(to))
    return c


def _composed(c: Column) -> Column:
    """The accents of each letter in canonical order, which the collation takes for granted; for distinct values."""

    def nfc(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    return F.pandas_udf(nfc, T.StringType())(c)


def _marks(c: Column) -> Column:
    """Marks that can be seen but that the collation passes over: all but the common accents and kana voicing, in order."""
    return F.regexp_replace(c, f"[^\\p{{M}}{_PASSED_OVER}]|[\\x{{300}}-\\x{{36F}}\\x{{3099}}\\x{{309A}}]", "")


_MAPPED = "__mapped"


def _classes(df: DataFrame, text_column: str, catalogue: DataFrame | None) -> tuple[list[str], DataFrame, DataFrame]:
    """The characters met; the rows of ``df`` that are not plain ASCII, mapped; and ``mapped, canonical, rows`` of the values
    that are not plain ASCII after it, those of ``catalogue`` included."""
    ship(df.sparkSession)
    text = F.col(text_column)
    texts = df.select(text.alias("text"))
    if catalogue is not None:
        texts = texts.unionByName(catalogue.select(F.col(catalogue.columns[0]).alias("text")))
    chars = _chars(texts)
    keyed = materialized(df.where(~text.rlike(PLAIN)).withColumn(_MAPPED, _form(text, chars)), "mapped")  # read three times
    members = keyed.select(_MAPPED, text.alias("text"), F.lit(1).alias("source"))
    if catalogue is not None:
        own = catalogue.select(F.col(catalogue.columns[0]).alias("text")).where(~F.col("text").rlike(PLAIN))
        members = members.unionByName(own.select(_form("text", chars).alias(_MAPPED), "text", F.lit(0).alias("source")))
    counted = members.where(~F.col(_MAPPED).rlike(PLAIN)).groupBy(_MAPPED, "text", "source").agg(F.count("*").alias("rows"))
    members = materialized(counted.withColumn("composed", _composed(F.col(_MAPPED))), "members")
    members = members.withColumns({"class": F.collate(F.col("composed"), "UNICODE"), "marks": _marks(F.col("composed"))})
    first = F.min(F.struct("source", (F.col(_MAPPED) != F.col("text")).cast("int").alias("changed"), F.char_length("text").alias("size"), "text"))
    classes = members.groupBy("class", "marks").agg(first["text"].alias("canonical"))
    values = members.groupBy(_MAPPED).agg(F.any_value("class").alias("class"), F.any_value("marks").alias("marks"), F.sum("rows").alias("__rows"))
    return chars, keyed, materialized(values.join(classes, ["class", "marks"]).select(_MAPPED, "canonical", "__rows"), "forms")


def _with_canonical(df: DataFrame, text_column: str, keyed: DataFrame, forms: DataFrame) -> DataFrame:
    text = F.col(text_column)
    plain = df.where(text.isNull() | text.rlike(PLAIN)).withColumn("canonical", text)
    turned = keyed.where(F.col(_MAPPED).rlike(PLAIN)).withColumn("canonical", F.col(_MAPPED))
    odd = split_join(keyed.where(~F.col(_MAPPED).rlike(PLAIN)), forms, [_MAPPED], "__rows")
    return plain.unionByName(turned.drop(_MAPPED)).unionByName(odd.drop(_MAPPED, "__rows"))


def canonical_forms(df: DataFrame, text_column: str, catalogue: DataFrame | None = None) -> DataFrame:
    """``df`` with ``canonical``, equal for texts that look the same.

    ``catalogue``: one column of texts that take part and are preferred as members.  Null gives null, '' and texts of
    invisible characters alone give ''.  Repeated rows stay.  ``df`` may have any other columns but ``canonical``.
    """
    _, keyed, forms = _classes(df, text_column, catalogue)
    return _with_canonical(df, text_column, keyed, forms)


def matches(df: DataFrame, text_column: str, catalogue: DataFrame, catalogue_text: str) -> DataFrame:
    """The rows of ``df`` that look like a text of ``catalogue`` but are another string, with the catalogue's columns.

    Column names must differ but for those of the texts.
    """
    known = catalogue.withColumnRenamed(catalogue_text, "__known")
    chars, keyed, forms = _classes(df, text_column, known.select("__known"))
    own = known.where(~F.col("__known").rlike(PLAIN)).withColumn(_MAPPED, _form("__known", chars))
    known = _with_canonical(known, "__known", own, forms)
    return _with_canonical(df, text_column, keyed, forms).join(known, "canonical").where(F.col(text_column) != F.col("__known")).drop("canonical", "__known")
