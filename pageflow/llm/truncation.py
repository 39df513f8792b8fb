"""Text cut off by field limits or in transfer.

The end of each value is classified: finished, inside a table or formula whose
end is missing, inside a sentence, or shaped like a heading.  A corpus
vocabulary of all values, without their final words, makes a trie, kept as rows;
a final word that is no known word but a proper prefix of known ones is the rest
of a cut word.  Lengths at which the values of a source end unfinished far more
often than at the lengths around are the limits of its field.  Every value that
doesn't end finished is scored by the trie, the limits and what its end leaves
open; ``by_evidence`` reports what each decides.

Defined results of odd input: null, empty and blank values are never cut; a
value that ends with a finished sentence, list entry, heading, caption, table,
formula or page number is complete, at whatever length; repeated rows are
judged alike; a null source is a group of its own.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.vocabulary import count_words, trie_nodes
from pageflow.session import checkpointed

#: A word that occurs less often is not known.
MIN_COUNT = 3
#: A length is a limit if so many values end there unfinished, and so many times as many as at the lengths within REACH.
LIMIT_ROWS, LIMIT_TIMES, REACH = 8, 5, 10
#: What each piece of evidence adds to a value's score, and the score from which it is cut.
WEIGHTS, CUT_SCORE = {"rest_of_word": 1.0, "at_limit": 1.0, "open": 1.0}, 1.0
_WORD = re.compile(r"[^\W\d_]+")
_LAST = re.compile(r"(?<![^\W\d_])[^\W\d_]+$")
_STOP = ".!?…。！？．"
_BLANK = " \t\r\n\f\v\u00a0\u2007\u202f\u3000\u00ad\u200b\u200c\u200d\u2060\ufeff"
_CLOSERS = "\"'”’»)]）」』*_"
_PAGE_NO = re.compile(r"\W*(?:(?:p|pp|s|с|стр|page|seite)\.?\s*)?(?:第?\d{1,4}(?:\s*/\s*\d{1,4})?页?|[ivxlcdm]{1,8})\W*", re.I)
_DONE_END = re.compile(r"(?:</?[a-z][^<>]*>|\|\}|\|\||\}\}|\]\]|\|)$", re.I)
_PAIRS = (("<table", "</table>"), ("{|", "|}"), ("\\begin{", "\\end{"), ("\\[", "\\]"), ("{{", "}}"), ("[[", "]]"))
_SMALL = frozenset("a an and at by for from in of on or the to with von der die das und la le les de des du et в на и из".split())
# Words that open sentences and no headings.
_OPENERS = frozenset(
    "a an according after although as at before between beyond by each every from if in it item neither no nothing some there they this two under we when where whether while with"
    " das der die dem den ein eine einer es für hinter im jede jeder jedes nach nichts ob seit um ungefähr unter vor wenn zwischen"
    " aucun aucune ce cette chaque dans elle entre il la le les par quelque rien selon si un une"
    " в если за из каждая каждый каждое на неизвестно около по после согласно то это".split()
)
_HAN_HEADING = re.compile(r"[㐀-鿿]{1,5}的[㐀-鿿]{2,4}")
_TITLES = frozenset(("paragraph_title", "doc_title", "title", "figure_caption", "figure_title", "table_caption", "header", "footer", "number", "image"))
_FORMULAS = frozenset(("display_formula", "formula", "inline_formula"))


def heading_like(line: str) -> bool:
    """Whether a line by itself has the shape of a heading, a caption or a running title."""
    bare = re.sub(r"^[#>=·\s\d]+|[=·\s\d]+$", "", line).strip()
    if not bare or len(bare) > 90 or bare[-1] in ",;:-":
        return False
    if re.search("[㐀-鿿]", bare):
        return bool(_HAN_HEADING.fullmatch(bare))
    words = _WORD.findall(bare)
    if not words or words[-1].lower() in _SMALL:
        return False
    if bare.isupper():
        return True
    if words[0].lower() in _OPENERS or not words[0][0].isupper() or "," in bare:
        return False
    large = [w for w in words[1:] if w.lower() not in _SMALL]
    return all(w[0].isupper() for w in large) or (len(words) == 2 and words[0].lower() not in ("notes", "on", "the"))


def end_state(text: str, label: str | None = None) -> tuple[str, str]:
    """("" if finished, else table, sentence or heading; the final word in lower case) of a value."""
    body = text.rstrip(_BLANK)
    if not body:
        return "", ""
    for start, end in _PAIRS:
        if start in body and body.rfind(start) > body.rfind(end) and body.count(start) > body.count(end):
            return "table", ""
    if body.count("$$") % 2 or body.count("```") % 2:
        return "table", ""
    head, _, line = body.rpartition("\n")
    line = line.strip()
    if line[0] == "|" and line[-1] != "|" and line.count("|") > 1 and not line.startswith(("|}", "|-")):
        return "table", ""
    if label in _FORMULAS or _PAGE_NO.fullmatch(line) or _DONE_END.search(line) or line.endswith(("$$", "```", "\\]")):
        return "", ""
    last = line.rstrip(_CLOSERS) or line
    if last[-1] in _STOP:
        return "", ""
    if line[-1] == "}" and re.search(r"\\[a-z]+\*?\{[^{}]*\}$|\\end\{[a-z*]+\}$", line):
        return "", ""
    if line[-1] == "$" and line.count("$") % 2 == 0:
        return "", ""
    word = m[0].lower() if (m := _LAST.search(body)) else ""
    if label in _TITLES:
        return "heading", word
    above = head.rstrip()
    alone = not above or head.endswith("\n") or head.rstrip(" \r").endswith("\n") or above[-1] in _STOP + ">|}$`" or heading_like(above.rpartition("\n")[2]) or bool(_PAGE_NO.fullmatch(above.rpartition("\n")[2].strip() or "x"))
    return ("heading" if alone and heading_like(line) else "sentence"), word


def known_words(text: str | None) -> list[str]:
    """The lower-case words of a value, without its final one."""
    return _WORD.findall(text.lower())[:-1] if text else []


def ends(values: DataFrame) -> DataFrame:
    """(tbl, row_id, source, chars, state, word) of the values of (tbl, row_id, source, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, i, s, label, text = (c.to_pylist() for c in batch.columns)
            state = [end_state(x, y) for x, y in zip(text, label, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(i, pa.int64()), pa.array(s, pa.string()), pa.array(list(map(len, text)), pa.int32()), pa.array([a for a, _ in state], pa.string()), pa.array([b for _, b in state], pa.string())], names=["tbl", "row_id", "source", "chars", "state", "word"])

    return values.filter(F.col("text") != "").select("tbl", "row_id", "source", "label", "text").mapInArrow(run, "tbl string, row_id bigint, source string, chars int, state string, word string")


def field_limits(state: DataFrame) -> DataFrame:
    """(tbl, source, chars): lengths at which values end unfinished far more often than at the lengths around."""
    by = state.groupBy("tbl", "source", "chars").agg(F.count_if(F.col("state").isin("sentence", "table")).alias("open"))
    around = Window.partitionBy("tbl", "source").orderBy("chars").rangeBetween(-REACH, REACH)
    return by.withColumn("near", F.sum("open").over(around) - F.col("open")).filter((F.col("open") >= LIMIT_ROWS) & (F.col("open") * 2 * REACH >= LIMIT_TIMES * F.col("near"))).select("tbl", "source", "chars")


def evidence(values: DataFrame) -> DataFrame:
    """(tbl, row_id, source, state, rest_of_word, at_limit, score) of every non-empty value.

    Each value that doesn't end finished is scored by the trie (its final word
    is unknown and a proper prefix of known words), by the limits (its length is
    one of its source's field) and by what its end leaves open (a sentence or a
    table); a value shaped like a heading leaves nothing open by itself.
    """
    state = checkpointed(ends(values))
    nodes = trie_nodes(count_words(values, ["text"], known_words).filter(F.col("n") >= MIN_COUNT)).withColumnRenamed("prefix", "word")
    limits = field_limits(state).withColumn("limit", F.lit(True))
    rest_of_word = ~F.coalesce("known", F.lit(False)) & (F.coalesce("below", F.lit(0)) > 0)
    opened = state.filter("state <> ''")
    scored = (
        opened.join(nodes, "word", "left")
        .join(limits, (opened.tbl == limits.tbl) & opened.source.eqNullSafe(limits.source) & (opened.chars == limits.chars), "left")
        .select(opened.tbl, opened.row_id, opened.source, "state", rest_of_word.alias("rest_of_word"), F.col("limit").isNotNull().alias("at_limit"))
    )
    done = state.filter("state = ''").select("tbl", "row_id", "source", "state", F.lit(False).alias("rest_of_word"), F.lit(False).alias("at_limit"))
    score = WEIGHTS["rest_of_word"] * F.col("rest_of_word").cast("double") + WEIGHTS["at_limit"] * F.col("at_limit").cast("double") + WEIGHTS["open"] * F.col("state").isin("sentence", "table").cast("double")
    return scored.unionByName(done).withColumn("score", score)


def judged(values: DataFrame) -> DataFrame:
    """(tbl, row_id, source, cut): every non-empty value with the verdict."""
    return evidence(values).select("tbl", "row_id", "source", (F.col("score") >= CUT_SCORE).alias("cut"))


def by_evidence(values: DataFrame) -> DataFrame:
    """(tbl, state, rest_of_word, at_limit, n_values, n_cut): how many values each combination of the evidence decides."""
    cut = F.count_if(F.col("score") >= CUT_SCORE).alias("n_cut")
    return evidence(values).groupBy("tbl", "state", "rest_of_word", "at_limit").agg(F.count(F.lit(1)).alias("n_values"), cut)


def rates(values: DataFrame) -> DataFrame:
    """(tbl, source, n_values, n_cut, cut_share) of each source."""
    return judged(values).groupBy("tbl", "source").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))
