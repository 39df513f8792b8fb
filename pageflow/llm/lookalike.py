"""Visually identical text with different characters, brought to one form.

Only white-space-bounded tokens that hold a suspect place are touched, and each
distinct token once: its text is exploded to positioned code points, these are
joined with broadcast decomposition and look-alike mappings (bounded by
Unicode), combining marks are ordered by their class behind their base, bases
and marks are recomposed, letters of another script inside a word are mapped to
the word's own script, and the token is rebuilt.  The result goes back to the
values by a join on the token.

Defined results of odd input: null and empty values are no cases and keep their
value; a token of any length is one group of its own code points; repeated rows
give repeated results; an accent without a composed form, a whole word of Greek
or Cyrillic and full-width punctuation stay.  Where a base has several marks,
all of them or the first are composed.  Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

KINDS = ("fullwidth", "combining", "zero_width", "nbsp", "lookalike")
# Ranges of code points, as the inside of a character class.
_LATIN = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u1E00-\u1EFF\uFF21-\uFF3A\uFF41-\uFF5A"
_GREEK = r"\u0370-\u0373\u0376-\u037D\u0386\u0388-\u03FF\u1F00-\u1FFF"
_CYRILLIC = r"\u0400-\u0482\u048A-\u052F"
_MARKS = r"\u0300-\u036F\u0483-\u0487\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20F0\uFE20-\uFE2F"
_ZERO = r"\u00AD\u034F\u061C\u180E\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF"
_SPACES = r"\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
_FULL = r"\uFF10-\uFF19\uFF21-\uFF3A\uFF41-\uFF5A"
_SINGLE = f"[{_FULL}{_MARKS}{_ZERO}{_SPACES}]"
_BETWEEN = f"[{_MARKS}{_ZERO}]*"
SUSPECT = f"{_SINGLE}|[{_LATIN}]{_BETWEEN}[{_GREEK}{_CYRILLIC}]|[{_GREEK}{_CYRILLIC}]{_BETWEEN}[{_LATIN}]|[{_GREEK}]{_BETWEEN}[{_CYRILLIC}]|[{_CYRILLIC}]{_BETWEEN}[{_GREEK}]"
# Letters of other scripts and the Latin letters that they look like.
CYRILLIC_AS_LATIN = "аa вb еe іi јj кk мm нh оo рp сc тt уy хx ѕs ԁd ԛq ԝw һh АA ВB ЕE ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ЅS ԌG"
GREEK_AS_LATIN = "αa ιi κk νv οo ρp υu χx γy ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
GREEK_AS_CYRILLIC = "αа εе κк οо ρр χх υу ΑА ΒВ ΕЕ ΗН ΙІ ΚК ΜМ ΟО ΡР ΤТ ΧХ"


def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s[0] for s in ("LATIN", "GREEK", "CYRILLIC") if s in name), "") if c.isalpha() else ""


@cache
def _tables() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(code point, parts, kind), (base and marks, composed) and (letter, script, as Latin, as Greek, as Cyrillic, distinctive)."""
    codes, composed, letters = [], [], []
    ranges = [(0x41, 0x5B), (0x61, 0x7B), (0xA0, 0x530), (0x1680, 0x1681), (0x180E, 0x180F), (0x1AB0, 0x2070), (0x20D0, 0x20F1), (0x3000, 0x3001), (0xFE20, 0xFE30), (0xFEFF, 0xFF00), (0xFF10, 0xFF5B)]
    pairs = {x[0]: x[1] for x in CYRILLIC_AS_LATIN.split()}
    greek = {x[0]: x[1] for x in GREEK_AS_LATIN.split()}
    across = {x[0]: x[1] for x in GREEK_AS_CYRILLIC.split()}
    back_c = {v: k for k, v in reversed(pairs.items())}
    back_g = {v: k for k, v in reversed(greek.items())}
    for c in (chr(x) for a, b in ranges for x in range(a, b)):
        category = unicodedata.category(c)
        kind, parts = "", unicodedata.normalize("NFD", c)
        if "０" <= c <= "９" or "Ａ" <= c <= "Ｚ" or "ａ" <= c <= "ｚ":
            kind, parts = "fullwidth", unicodedata.normalize("NFKC", c)
        elif c == "\u00AD" or c == "\u034F" or category == "Cf":
            kind, parts = "zero_width", ""
        elif category == "Zs":
            kind, parts = "nbsp", " "
        elif unicodedata.combining(c):
            kind = "mark"
        if kind or parts != c:
            codes.append((c, [(p, unicodedata.combining(p)) for p in parts], kind))
            if not kind and len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
                composed.append((parts, c))
        if (s := _script(c)) and kind != "fullwidth":
            latin = pairs.get(c) or greek.get(c)
            row = {"L": (c, back_g.get(c), back_c.get(c)), "C": (latin, {v: k for k, v in across.items()}.get(c), c), "G": (latin, c, across.get(c))}[s]
            letters.append((c, s, *row, 0 if sum(x is not None for x in row) > 1 else 1))
    return codes, composed, letters


def mappings(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three mapping tables; their sizes are bounded by Unicode (a few thousand rows)."""
    codes, composed, letters = _tables()
    parts = T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("ccc", T.IntegerType())]))
    a = spark.createDataFrame(codes, T.StructType([T.StructField("ch", T.StringType()), T.StructField("parts", parts), T.StructField("kind", T.StringType())]))
    b = spark.createDataFrame(composed, "canonical string, composed string")
    c = spark.createDataFrame(letters, "letter string, script string, as_l string, as_g string, as_c string, distinctive int")
    return F.broadcast(a), F.broadcast(b), F.broadcast(c)


def normalize_tokens(tokens: DataFrame) -> DataFrame:
    """(token, normal, kinds) of the distinct tokens of the column ``token``."""
    codes, composed, letters = mappings(tokens.sparkSession)
    points = tokens.select("token").distinct().select("token", F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), 0)).alias("pos", "ch")).join(codes, "ch", "left")
    parts = points.select("token", "pos", "kind", F.posexplode_outer(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"))))).alias("sub", "part"))
    order = Window.partitionBy("token").orderBy("pos", "sub")
    visible = F.col("part").isNotNull()
    clustered = parts.withColumn("cluster", F.sum(F.when(visible & (F.col("part.ccc") == 0), 1).otherwise(0)).over(order))
    marks = F.sort_array(F.collect_list(F.when(visible, F.struct(F.col("part.ccc").alias("ccc"), "pos", "sub", F.col("part.c").alias("c")))))
    clusters = clustered.groupBy("token", "cluster").agg(marks.alias("m"), F.max(F.col("kind") == "mark").alias("marked"), F.collect_set(F.when(~F.col("kind").isin("", "mark"), F.col("kind"))).alias("kinds"))
    clusters = clusters.withColumns({"canonical": F.array_join(F.col("m.c"), ""), "first": F.array_join(F.slice(F.col("m.c"), 1, 2), ""), "rest": F.array_join(F.slice(F.col("m.c"), 3, 1 << 20), "")})
    one = composed.select(F.col("canonical").alias("first"), F.col("composed").alias("composed_first"))
    whole = clusters.join(composed, "canonical", "left").join(one, "first", "left")
    form = F.coalesce("composed", F.concat("composed_first", "rest"), "canonical")
    formed = whole.select("token", "cluster", form.alias("form"), F.when(F.col("marked") & (form != F.col("canonical")), F.array_append("kinds", F.lit("combining"))).otherwise(F.col("kinds")).alias("kinds"), F.substring(form, 1, 1).alias("letter"))
    lettered = formed.join(letters, "letter", "left")
    run = F.sum(F.when(F.col("script").isNull() & (F.col("form") != ""), 1).otherwise(0)).over(Window.partitionBy("token").orderBy("cluster"))
    in_run = Window.partitionBy("token", "run")

    def score(s: str) -> Column:
        return F.sum(F.when(F.col("script") == s, 100 * F.col("distinctive") + 1).otherwise(0)).over(in_run)

    scored = lettered.withColumn("run", run).withColumns({f"n_{s.lower()}": score(s) for s in "LCG"})
    mixed = ((F.col("n_l") > 0).cast("int") + (F.col("n_c") > 0).cast("int") + (F.col("n_g") > 0).cast("int") > 1) & F.col("script").isNotNull()
    own = F.when((F.col("n_l") >= F.col("n_c")) & (F.col("n_l") >= F.col("n_g")), F.col("as_l")).when(F.col("n_c") >= F.col("n_g"), F.col("as_c")).otherwise(F.col("as_g"))
    out = F.when(mixed, F.concat(F.coalesce(own, F.col("letter")), F.expr("substring(form, 2)"))).otherwise(F.col("form"))
    final = scored.select("token", "cluster", out.alias("out"), F.when(mixed, F.array_append("kinds", F.lit("lookalike"))).otherwise(F.col("kinds")).alias("kinds"))
    rebuilt = final.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("cluster", "out"))).alias("o"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))
    return rebuilt.select("token", F.array_join(F.col("o.out"), "").alias("normal"), "kinds")


def _values(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in fields]))
    return df.select(F.col(id_col).alias("id"), each.alias("v")).select("id", "v.field", "v.text").filter("text is not null")


def _suspect(c: str) -> Column:
    return (F.octet_length(c) > F.char_length(c)) & F.col(c).rlike(SUSPECT)


def _segments() -> Column:
    return F.split("text", r"(?<=[ \n\t\r])")


def found(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, field, kind): which kinds of deviating characters each value has."""
    tokens = _values(df, id_col, fields).filter(_suspect("text")).select("id", "field", F.explode(_segments()).alias("token")).filter(_suspect("token"))
    kinds = normalize_tokens(tokens).filter(F.size("kinds") > 0).select("token", F.explode("kinds").alias("kind"))
    return tokens.join(kinds, "token").select("id", "field", "kind").distinct()


def normalized(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, field, normal): every value in its one consistent form; values without a suspect place pass unchanged."""
    values = _values(df, id_col, fields)
    pieces = values.filter(_suspect("text")).select("id", "field", F.posexplode(_segments()).alias("seg", "token"))
    forms = normalize_tokens(pieces.filter(_suspect("token"))).select("token", "normal")
    whole = pieces.join(forms, "token", "left").groupBy("id", "field").agg(F.sort_array(F.collect_list(F.struct("seg", F.coalesce("normal", "token").alias("t")))).alias("s"))
    return values.filter(~_suspect("text")).select("id", "field", F.col("text").alias("normal")).unionByName(whole.select("id", "field", F.array_join(F.col("s.t"), "").alias("normal")))
