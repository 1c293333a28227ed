"""One stored form for texts that look the same.

The text column reaches Python as an Arrow buffer and is handled as one array of code points
per batch: table gathers decompose, unify and delete characters, expansion offsets make
room, and marks are reordered and composed with array operations. No step calls into a single
row's string. The tables are built by rule from the Unicode data of the Python at hand.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.frequent import join_counted
from weftline.session import cut, ship

# Letters of other alphabets that are drawn like a Latin letter.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухԁԛԝһѵӏ", "ABESIJKMHOPCTYXGQWaesijopcyxdqwhvl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳον", "ABEZHIKMNOPTYXCjov"),
    "Armenian": ("Օօոսհ", "Oonuh"),
    "Latin": ("ɑɡıɩ", "agıι"),
}
# Characters without width that are not of the format category (Cf).
UNSEEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# Format characters that are drawn (number and year signs before digits).
SEEN = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
#: Compatibility forms that are drawn as their parts are. Circled, raised, lowered, squared and
#: font variants look different and stay.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Blocks of the alphabets; a word with letters that only one of them has is written in it.
LATIN_BLOCKS = (range(0x41, 0x5B), range(0x61, 0x7B), range(0xAA, 0x250), range(0x1E00, 0x1F00))
OWN_SCRIPT = {"Cyrillic": (range(0x400, 0x530), range(0x1C80, 0x1C90), range(0xA640, 0xA6A0)), "Greek": (range(0x370, 0x400), range(0x1F00, 0x2000))}
BASIC = {"Cyrillic": range(0x400, 0x460), "Greek": range(0x386, 0x3CF)}
LIMIT = 0xE0200
_TAIL = 0x110000


@dataclass(frozen=True)
class Tables:
    """``start``/``size``: a code point's replacement in ``flat`` (size -1: itself). ``ccc``: combining
    class. ``pairs``/``joined``: composable pairs as one number each, sorted, and their result.
    ``letter``: 1 for letters and marks, 2 for Latin letters, 3 and up for letters that only one of the
    other alphabets has. ``back``: for each of these alphabets its letter for a Latin one, or 0."""

    start: np.ndarray
    size: np.ndarray
    flat: np.ndarray
    ccc: np.ndarray
    pairs: np.ndarray
    joined: np.ndarray
    letter: np.ndarray
    back: list[np.ndarray]


@lru_cache(maxsize=2)
def tables(looks: bool = True) -> Tables:
    """The tables for looks, or for canonical composition only (``looks=False``, the NFC form)."""
    alike = {}
    if looks:
        for theirs, ours in LOOK_ALIKES.values():
            alike |= {ord(a): ord(b) for a, b in zip(theirs, ours)}
    unseen, seen = set(UNSEEN), set(SEEN)
    size, start, flat = np.full(LIMIT, -1, np.int32), np.zeros(LIMIT, np.int32), []
    ccc = np.zeros(LIMIT, np.uint8)
    pairs: dict[int, int] = {}

    def parts(ch: str) -> list[int]:
        if looks:
            given = unicodedata.decomposition(ch)
            tag, _, rest = given.partition(" ") if given.startswith("<") else ("", "", "")
            letters = [chr(int(x, 16)) for x in rest.split()]
            joined = tag == "<compat>" and all(unicodedata.category(x)[0] == "L" for x in letters) and (len(letters) > 1 or "ROMAN NUMERAL" in unicodedata.name(ch, ""))
            if tag in SAME_SHAPE or joined:
                return [p for x in letters for p in parts(x)]
            category = unicodedata.category(ch)
            if category == "Zs":
                return [0x20]
            if (category == "Cf" and ord(ch) not in seen) or ord(ch) in unseen:
                return []
        return [alike.get(ord(x), ord(x)) for x in unicodedata.normalize("NFD", ch)]

    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, LIMIT)]:
        ch = chr(cp)
        if unicodedata.category(ch) == "Cn" and cp not in unseen:
            continue
        ccc[cp] = unicodedata.combining(ch)
        becomes = parts(ch)
        if becomes != [cp]:
            start[cp], size[cp] = len(flat), len(becomes)
            flat += becomes
        canonical = unicodedata.normalize("NFD", ch)
        if canonical != ch and unicodedata.normalize("NFC", canonical) == ch:
            split = [ord(x) for x in unicodedata.normalize("NFC", canonical[:-1])] + [ord(canonical[-1])]
            if len(split) == 2:
                # Of several letters with one look the first, the Latin one, gives the joined form.
                pairs.setdefault(alike.get(split[0], split[0]) * _TAIL + split[1], cp)
                pairs[split[0] * _TAIL + split[1]] = cp
    keys = np.array(sorted(pairs), np.int64)
    letter = np.zeros(LIMIT, np.uint8)
    letter[[cp for cp in [*range(0x41, 0x3000), *range(0xA640, 0xAC00)] if unicodedata.category(chr(cp))[0] in "LM"]] = 1
    for block in LATIN_BLOCKS:
        letter[block.start : block.stop] *= 2
    back = []
    for n, (script, blocks) in enumerate(OWN_SCRIPT.items() if looks else (), 3):
        for block in blocks:
            letter[[cp for cp in block if letter[cp] and cp not in alike and not unicodedata.combining(chr(cp))]] = n
        theirs = np.zeros(LIMIT, np.int32)
        for a, b in zip(*LOOK_ALIKES[script]):
            if ord(a) in BASIC[script]:
                theirs[ord(b)] = theirs[ord(b)] or ord(a)
        back.append(theirs)
    return Tables(start, size, np.array(flat, np.int32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), letter, back)


def _joined(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composed character of each pair, or -1."""
    key = a.astype(np.int64) * _TAIL + b
    at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
    return np.where(t.pairs[at] == key, t.joined[at], -1)


def _expand(t: Tables, cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.minimum(cp, LIMIT - 1)
    size = np.where(cp < LIMIT, t.size[inside], -1)
    itself = size < 0
    if itself.all():
        return cp, row
    n = np.where(itself, 1, size)
    at = np.repeat(np.arange(len(cp)), n)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    own = itself[at]
    out = cp[at]
    from_table = ~own
    out[from_table] = t.flat[t.start[inside[at[from_table]]] + offset[from_table]]
    return out, row[at]


def _classes(t: Tables, cp: np.ndarray) -> np.ndarray:
    return np.where(cp < LIMIT, t.ccc[np.minimum(cp, LIMIT - 1)], 0)


def _own_script(t: Tables, cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words with letters that only one other alphabet has are written in it throughout, if it has all
    their letters; so a Russian word stays Russian, whichever of its letters were Latin. This
    depends on the unified word alone: words that look the same still come out the same."""
    kind = np.where(cp < LIMIT, t.letter[np.minimum(cp, LIMIT - 1)], 0)
    if not (kind > 2).any():
        return cp
    word = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | ((kind[1:] > 0) != (kind[:-1] > 0))])) - 1
    has = lambda x: np.bincount(word[x], minlength=word[-1] + 1) > 0
    inside = np.minimum(cp, LIMIT - 1)
    for n, back in enumerate(t.back, 3):
        theirs = back[inside]
        turns = has(kind == n) & ~has((kind > 2) & (kind != n)) & ~has((kind == 2) & (theirs == 0))
        cp = np.where(turns[word] & (kind == 2), theirs, cp)
    return cp


def _compose(t: Tables, cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition, row by row."""
    ccc = _classes(t, cp)
    if not len(cp):
        return cp, row
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    segment = np.cumsum((ccc == 0) | new_row)
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (segment[1:] == segment[:-1])).any():
        order = np.lexsort((ccc, segment))
        cp, ccc = cp[order], ccc[order]
    keep = np.ones(len(cp), bool)
    heads = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    marks = np.diff(np.append(heads, len(cp))) - 1
    usable = (ccc[heads] == 0) & (marks > 0)
    heads, marks = heads[usable], marks[usable]
    cp = cp.copy()
    blocked = np.zeros(len(heads), ccc.dtype)  # class of the last mark that stayed
    k = 0
    while len(heads):
        k += 1
        at = heads + k
        both = _joined(t, cp[heads], cp[at])
        joins = (both >= 0) & (ccc[at] != blocked)
        cp[heads[joins]] = both[joins]
        keep[at[joins]] = False
        blocked = np.where(joins, blocked, ccc[at])
        more = marks > k
        heads, marks, blocked = heads[more], marks[more], blocked[more]
    cp, row, ccc = cp[keep], row[keep], ccc[keep]
    # Letters that compose with the next letter (syllable blocks, some vowel signs).
    while len(cp) > 1:
        both = np.where((ccc[1:] == 0) & (ccc[:-1] == 0) & (row[1:] == row[:-1]) & (cp[:-1] > 0x7F), _joined(t, cp[:-1], cp[1:]), -1)
        joins = both >= 0
        joins[1:] &= ~joins[:-1]
        if not joins.any():
            break
        at = np.flatnonzero(joins)
        cp[at] = both[at]
        rest = np.ones(len(cp), bool)
        rest[at + 1] = False
        cp, row, ccc = cp[rest], row[rest], ccc[rest]
    return cp, row


def unify(texts: pa.Array, looks: bool = True) -> pa.Array:
    """The common form of every text; nulls stay null, empty texts empty."""
    t = tables(looks)
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if n == 0 or not (data > 0x7F).any():
        return texts
    ends = offsets - offsets[0]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.repeat(np.arange(n), np.diff(begins[ends]))
    cp, row = _expand(t, cp, row)
    if looks and len(cp):
        cp = _own_script(t, cp, row)
    cp, row = _compose(t, cp, row)
    out = cp.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
    sizes = np.bincount(row, weights=width, minlength=n).astype(np.int64)
    new = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    valid = None if texts.null_count == 0 else pc.is_valid(texts).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), n, [valid, pa.py_buffer(new), pa.py_buffer(out)])


#: Bytes of text that are expanded at once; a single longer text is one piece.
PIECE = 1 << 20


def unify_in_pieces(texts: pa.Array, looks: bool = True) -> pa.Array:
    """``unify`` over slices of bounded size, so that the arrays of a batch of long texts stay small.

    Texts of ASCII only are in the common form already: only the others are taken apart."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    rows = np.unique(np.searchsorted(offsets - offsets[0], np.flatnonzero(data > 0x7F), side="right") - 1)
    if not len(rows):
        return texts
    source = np.arange(len(texts))
    source[rows] = len(texts) + np.arange(len(rows))
    return pa.concat_arrays([texts, _pieces(texts.take(pa.array(rows)), looks)]).take(pa.array(source))


def _pieces(texts: pa.Array, looks: bool) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    pieces, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        pieces.append(unify(texts.slice(at, to - at), looks))
        at = to
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.large_string())


@lru_cache(maxsize=1)
def _unify_column():
    @F.arrow_udf("string")
    def common_form(texts: pa.Array) -> pa.Array:
        return unify_in_pieces(texts).cast(pa.string())

    return common_form


def common_form(text: Column) -> Column:
    """A column expression for the common form of a text column (see ``unify``)."""
    return _unify_column()(text)


def same_look_classes(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, look_id, form_id, n_forms)`` for every document that shows a visible character.

    Documents that look the same share ``look_id`` (the least of their ids), those that are also
    stored the same share ``form_id``; ``n_forms`` is the number of stored forms of the look.
    Null, empty and blank texts show nothing and are left out. Ids are unique integers;
    further columns are not read.
    """
    rows, forms = _forms(docs, id_column, text_column)
    return join_counted(rows, forms, "raw", "n", ["look_id", "form_id", "n_forms"]).select("id", "look_id", "form_id", "n_forms")


def _forms(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """``(id, raw)`` of every document that shows something, and ``(raw, n, look_id, form_id, n_forms)`` of every stored form; texts and
    looks are known by digests. A stored form has one look, so documents are joined on their form alone, and looks with forms only."""
    ship(docs.sparkSession)
    seen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter(F.col("text").isNotNull())
    forms = seen.select("id", F.unhex(F.sha2("text", 256)).alias("raw"), common_form(F.col("text")).alias("form"))
    rows = cut(forms.filter(F.col("form").rlike(r"[^\s]")).select("id", "raw", F.unhex(F.sha2("form", 256)).alias("look")))
    stored = cut(rows.groupBy("raw").agg(F.min("id").alias("form_id"), F.count(F.lit(1)).alias("n"), F.first("look").alias("look")))
    looks = cut(stored.groupBy("look").agg(F.min("form_id").alias("look_id"), F.count(F.lit(1)).alias("n_forms")))
    return rows.select("id", "raw"), cut(join_counted(stored, looks, "look", "n_forms", ["look_id", "n_forms"]).select("raw", "n", "look_id", "form_id", "n_forms"))


def same_look_pairs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: documents that look the same and are stored differently.

    Stored forms are paired once for each look that has several, then expanded to their
    documents; documents whose look has one form never reach a join on the look.
    """
    rows, stored = _forms(docs, id_column, text_column)
    stored = stored.filter("n_forms > 1")
    classes = cut(join_counted(rows, stored, "raw", "n", ["look_id", "form_id"]).select("id", "look_id", "form_id"))
    forms = stored.select("look_id", "form_id")
    other = forms.select("look_id", F.col("form_id").alias("form_b"))
    pairs = forms.withColumnRenamed("form_id", "form_a").join(other, "look_id").filter("form_a < form_b").select("form_a", "form_b")
    left = classes.select(F.col("form_id").alias("form_a"), F.col("id").alias("a"))
    right = classes.select(F.col("form_id").alias("form_b"), F.col("id").alias("b"))
    out = pairs.join(left, "form_a").join(right, "form_b")
    return out.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
