"""Cleaning texts and cutting them into tokens, as column expressions.

The order of the steps matters: lower-casing, then version-control logs, addresses, paths,
quoted lines, traces and code, then tokens, then the treatment of each token.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftline.config import TextConfig
from weftline.functions.stem import porter
from weftline.session import ship

# Fixed values: (only with SC?, pattern, replacement), in order. (?U): letters of all alphabets
# are word characters; (?d): only a line feed ends a line. A run that spans lines is written
# [\s\S]*, and loops are possessive where nothing follows: the matches are the same, without
# recursion on long texts.
CLEANING = (
    (True, r"(?Ud)[C|c]hecking\sin[\s\S]*done", "\n"),
    (True, r"(?Ud)[C|c]hecking\sin[\s\S]*revision.*\n", "\n"),
    (True, r"(?Ud)/cvs/[\s\S]*revision.*\n", "\n"),
    (False, r"(?Ud)(?<!\w)\w++://\S++", " "),
    (False, r"(?Ud)(?<!\w)(?:\w++/\w++(?:/\w++)++|\w++(?:\\\w++)++)", " "),
    (False, r"(?Ud)\n>.*\n", "\n "),
    (True, r"(?Ud)\n\s*at\s*\S+\(.*\)", "\n "),
    (True, r"(?Ud)\n[\w.]+[e|E]xception.*(?=\n)", "\n "),
    (True, r"(?Ud)--\s[E|e]rror\s[D|d]etails[\s\S]*[E|e]xception\s[S|s]tack\s[t|T]race:", "\n "),
    (True, r"(?Ud)[B|b]uild\s[I|i][d|D].*\n", "\n "),
    (True, r"(?Ud)[U|u]ser-[A|a]gent.*\n", "\n "),
    (True, r"(?Ud)[S|s]teps.*[R|r]eproduce:", " "),
    (True, r"(?Ud)[M|m]ore\s[I|i]nformation:", " "),
    (True, r"(?Ud)[R|r]eproducible:.*(?=\n)", " "),
    (True, r"(?Ud)\n[T|t]hread\s\[.*\n(?:.*line.*\n)++", "\n "),
    (True, r"(?Ud)\n.*[;|}{](?=\n)", "\n "),
)
TOKEN = r"(?U)\b[a-zA-Z|]\w*+(?:[.\-']*+\w++)*+"
WORD = r"(?U)\w+"


def assemble(title: Column, description: Column, comments: Column, config: TextConfig = TextConfig()) -> Column:
    """The document of a record: title (twice with DW), description, and with AC all comments.

    Missing parts count as empty; missing comments as none.
    """
    empty = F.lit("")
    head = F.coalesce(title, empty)
    text = F.concat(head, F.lit("\n "), head) if config.double_title else head
    text = F.concat(text, F.lit("\n "), F.coalesce(description, empty))
    if config.all_comments:
        each = F.transform(F.coalesce(comments, F.array().cast("array<string>")), lambda c: F.concat(F.lit("\n "), F.coalesce(c, empty)))
        text = F.concat(text, F.array_join(each, ""))
    return text


def _steps(config: TextConfig) -> Iterable[tuple[str, str]]:
    return [(pattern, by) for code, pattern, by in CLEANING if config.source_code or not code]


def clean(text: Column, config: TextConfig = TextConfig()) -> Column:
    """The text without addresses, paths and quoted lines, and with SC without code and form text."""
    text = F.lower(text) if config.lower else text
    for pattern, by in _steps(config):
        text = F.regexp_replace(text, pattern, by)
    return text


def removed(text: Column, config: TextConfig = TextConfig()) -> Column:
    """How many matches the cleaning removes."""
    text, count = F.lower(text) if config.lower else text, F.lit(0)
    for pattern, by in _steps(config):
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, by)
    return count


def raw_tokens(text: Column) -> Column:
    """Tokens of a cleaned text: a letter (or bar), then word characters with inner . - _ '"""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def correct(token: Column, corrections: dict[str, str]) -> Column:
    """The corrected spelling of a token; upper and lower case differ."""
    if not corrections:
        return token
    table = F.create_map(*[F.lit(x) for pair in corrections.items() for x in pair])
    # A hashed set tells the few tokens that have an entry; only these search the table.
    return F.when(token.isin(list(corrections)), F.try_element_at(table, token)).otherwise(token)


def english_stop_words() -> list[str]:
    spark = SparkSession.active()
    return list(spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"))


def tokens(text: Column, config: TextConfig = TextConfig()) -> Column:
    """The tokens of a document, or its pairs of neighbouring tokens with BG.

    The stop test looks at the token as written, whatever its case; corrections, the removal of
    apostrophes and stemming apply to the others. With SR and BG a stop word ends the running
    pair, unchanged but for its spelling. Null texts have no tokens.
    """
    stops = []
    if config.stop_words:
        stops = list(config.stop_list) if config.stop_list is not None else english_stop_words()
        stops += list(config.extra_stop_list) if config.spelling else []
    stop_set = sorted({s.lower() for s in stops})  # a hashed set in the plan
    words = raw_tokens(clean(F.coalesce(text, F.lit("")), config))

    def prepared(token: Column) -> Column:
        stop = F.lower(token).isin(stop_set) if stop_set else F.lit(False)
        fixed = correct(token, dict(config.corrections)) if config.spelling else token
        return F.struct(F.when(stop, fixed).otherwise(F.translate(fixed, "'", "")).alias("s"), stop.alias("stop"))

    marked = F.transform(words, prepared)
    if not config.bigrams:
        kept = F.transform(F.filter(marked, lambda x: ~x["stop"]), lambda x: x["s"])
        return stem_all(kept) if config.stemming else kept
    if config.stemming:
        stems = stem_all(F.transform(marked, lambda x: x["s"]))
        marked = F.zip_with(marked, stems, lambda x, s: F.struct(F.when(x["stop"], x["s"]).otherwise(s).alias("s"), x["stop"].alias("stop")))
    pairs = F.zip_with(marked, F.slice(marked, F.lit(2), F.greatest(F.size(marked), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda p: ~p["a"]["stop"] & p["b"].isNotNull() & (p["a"]["s"] != ""))
    return F.transform(pairs, lambda p: F.concat_ws(" ", p["a"]["s"], p["b"]["s"]))


@lru_cache(maxsize=4)
def _stem_column(stemmer):
    @F.arrow_udf("array<string>")
    def stem_lists(lists: pa.Array) -> pa.Array:
        # Each distinct word of a batch is stemmed once.
        words = pc.dictionary_encode(lists.flatten())
        stems = pa.array([None if w is None else stemmer(w) for w in words.dictionary.to_pylist()], pa.string())
        flat = stems.take(words.indices)
        return pa.ListArray.from_arrays(_offsets(lists), flat, mask=lists.is_null() if lists.null_count else None)

    return stem_lists


def _offsets(lists: pa.ListArray) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array([0, *sizes.cumsum().tolist()], pa.int32())


def stem_all(words: Column, stemmer=porter) -> Column:
    """The stems of an array of words, in place."""
    ship(SparkSession.active())
    return _stem_column(stemmer)(words)


def character_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams, with the shorter ones at the beginning and the end."""
    size = F.length(text)
    heads = [F.when(size >= i, F.substring(text, 1, i)) for i in range(1, n)]
    tails = [F.when(size >= i, F.substring(text, -i, i)) for i in range(n - 1, 0, -1)]
    inner = F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(F.array(*heads).cast("array<string>"), inner, F.array(*tails).cast("array<string>"))))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two sets; 0 where both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def ascii_words(text: Column, longest: int = 256) -> Column:
    """Words of an ASCII tokeniser: letters, lower-cased, and digits; other ASCII characters
    separate, characters beyond ASCII vanish. A word at the very end counts too. After ``longest`` characters a word ends and
    the following ones begin another: no character is lost."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "")
    return F.regexp_extract_all(F.lower(plain), F.lit(f"[a-z0-9]{{1,{longest}}}"), F.lit(0))


def without_stop_words(words: Column, stop_list: list[str]) -> Column:
    """Whole-word removal, in any case."""
    stop = sorted({s.lower() for s in stop_list})
    return F.filter(words, lambda w: ~F.lower(w).isin(stop)) if stop else words


def words(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def to_ascii(text: Column) -> Column:
    """Characters beyond ASCII become question marks."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def decimal_points(line: Column) -> Column:
    """Every comma becomes a point (a line with decimal commas)."""
    return F.translate(line, ",", ".")


def call_lines(line: Column) -> Column:
    """``caller||callee`` of fully qualified names as three lines: the classes, the methods (a
    constructor is called <init>), and the calling class with the called one."""
    caller = F.split(F.substring_index(line, "||", 1), r"\.")
    callee = F.split(F.substring(line, F.locate("||", line) + 2, F.length(line)), r"\.")
    bare = lambda c: F.substring_index(c, "(", 1)
    cls, method = F.try_element_at(caller, F.lit(-2)), bare(F.try_element_at(caller, F.lit(-1)))
    owner = F.array_join(F.slice(callee, F.lit(1), F.greatest(F.size(callee) - 1, F.lit(0))), ".")
    called = bare(F.try_element_at(callee, F.lit(-1)))
    called = F.when(called == F.try_element_at(callee, F.lit(-2)), "<init>").otherwise(called)
    return F.array(F.concat_ws(" ", cls, cls), F.concat(cls, F.lit(":"), method, F.lit(" "), owner, F.lit(":"), called), F.concat_ws(" ", cls, owner))


def score_line(line: Column) -> Column:
    """``method||score`` as ``Class:method': score``, or ``Class': score`` for a constructor."""
    name = F.split(F.substring_index(line, "||", 1), r"\.")
    score = F.substring(line, F.locate("||", line) + 2, F.length(line))
    cls, method = F.try_element_at(name, F.lit(-2)), F.substring_index(F.try_element_at(name, F.lit(-1)), "(", 1)
    return F.when(cls == method, F.concat(cls, F.lit("': "), score)).otherwise(F.concat(cls, F.lit(":"), method, F.lit("': "), score))
