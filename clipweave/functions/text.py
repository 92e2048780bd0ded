"""Text rules as Column builders; only the run folds need a vectorised Python helper."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Punctuation sets.
CUT_PUNCT = "。！？…、，,.!?;；:：—～~"
SPLIT_PUNCT = "，。？！,.?!~:：—…"
CLAUSE_PUNCT = ",.;?!、，。？！：…"
SHORT_PUNCT = "!?…,.-"

# Symbol replacements for Chinese text.
SYMBOL_MAP = {
    "：": ",", "；": ",", "，": ",", "。": ".", "！": "!", "？": "?", "\n": ".", "·": ",",
    "、": ",", "...": "…", "$": ".", "/": ",", "—": "-", "~": "…", "～": "…",
}

_SPACE = r"[\s　 ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, also the ideographic space."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def _tail(c: Column) -> Column:
    """What decides whether a text ends with something: ``$`` also stands before a last line end of one or two characters."""
    return F.substring(c, -3, 3)


def strip_newlines(c: Column) -> Column:
    ends = c.startswith("\n") | F.contains(_tail(c), F.lit("\n"))
    return F.when(ends, F.regexp_replace(c, r"^\n+|\n+$", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def clean_transcript(c: Column) -> Column:
    """Remove bracketed remarks and ideographic spaces, then trim."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), "　", ""))


def collapse_punct(c: Column, punct: str = SHORT_PUNCT, first_space: bool = False) -> Column:
    """Runs of punctuation shrink to their first character."""
    inside = "".join("\\" + p for p in punct)
    head = inside + r"\s" if first_space else inside
    return F.regexp_replace(c, f"([{head}])([{inside}])+", "$1")


def fold_width(c: Column) -> Column:
    """Full-width letters, digits and space to their half-width forms."""
    half = "".join(chr(x) for r in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)) for x in r)
    full = "".join(chr(ord(x) + 0xFEE0) for x in half)
    return F.translate(c, full + "　", half + " ")


def map_symbols(c: Column) -> Column:
    """Unify symbols, then keep only CJK characters and the short punctuation set."""
    c = F.translate(c, "嗯呣", "恩母")
    c = F.regexp_replace(c, r"\.\.\.", SYMBOL_MAP["..."])
    one = {k: v for k, v in SYMBOL_MAP.items() if len(k) == 1}
    c = F.translate(c, "".join(one), "".join(one.values()))
    keep = "".join("\\" + p for p in SHORT_PUNCT)
    return F.regexp_replace(c, rf"[^一-龥{keep}]+", "")


def strip_tags(c: Column) -> Column:
    """Remove recogniser tags such as <|ja|> and trim."""
    return strip(F.regexp_replace(c, r"<\|[^|]*\|>", ""))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def unify_ellipsis(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("……"), F.lit("。")), F.lit("——"), F.lit("，"))


def pieces(c: Column, punct: str = SPLIT_PUNCT) -> Column:
    """Split after every delimiter, keeping it; the text always ends with one.

    A split, as extracting match after match takes several times as long.
    """
    cls = "".join("\\" + p for p in punct)

    def parts(c: Column) -> Column:
        ended = _tail(c).rlike(f"(?s)[{cls}]$") & ~c.endswith("\n")
        whole = F.when(ended, c).otherwise(F.concat(c, F.lit("。")))
        # what stands behind the last delimiter: nothing, or a line end
        return let(F.split(whole, f"(?<=[{cls}])"), lambda p: F.slice(p, 1, F.size(p) - 1))

    return let(unify_ellipsis(c), parts)


def sentences(c: Column) -> Column:
    """Sentences of Chinese text: spaces and odd symbols dropped, closing quotes kept."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), r"[—《》【】<>{}()（）#&@“”^_|\\]", "")
    c = F.regexp_replace(c, r"([：、，；。？！,;?!][”’]?)", "$1\n")
    return F.transform(F.split(strip(c), r"\n+"), strip)


def _only_of(c: Column, chars: str) -> Column:
    cls = "".join("\\" + p for p in chars)
    return c.rlike(rf"(?s)\A[{cls}]*\z")


def _keep_wordy(parts: Column, chars: str = SHORT_PUNCT) -> Column:
    return F.filter(parts, lambda x: ~_only_of(x, chars))


def cut_none(c: Column) -> Column:
    return F.array(F.when(_only_of(c, SHORT_PUNCT), F.lit("\n")).otherwise(c))


def cut_fours(c: Column) -> Column:
    """Groups of four pieces; the last two groups are one."""

    def group(text: Column, p: Column) -> Column:
        n = F.size(p)
        groups = F.greatest(F.ceil(n / 4).cast("int") - 1, F.lit(1))
        grouped = F.transform(
            F.sequence(F.lit(0), groups - 1),
            lambda g: F.array_join(
                F.slice(p, g * 4 + 1, F.when(g == groups - 1, n).otherwise(F.lit(4))), ""
            ),
        )
        return _keep_wordy(F.when(n <= 8, F.array(text)).otherwise(grouped))

    return let(strip_newlines(c), lambda t: let(pieces(t), lambda p: group(t, p)))


def _pack(parts: Column, full: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
    """Append pieces to a buffer; move it out whenever ``full(buffer)`` holds."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(acc: Column, x: Column) -> Column:
        return let(
            F.concat(acc["buf"], x),
            lambda buf: F.struct(
                F.when(full(buf), F.array_append(acc["out"], buf)).otherwise(acc["out"]).alias("out"),
                F.when(full(buf), F.lit("")).otherwise(buf).alias("buf"),
            ),
        )

    return F.aggregate(parts, start, add, end)


def _join_last(out: Column, tail: Column) -> Column:
    """Glue ``tail`` to the last element of a non-empty array."""
    n = F.size(out)
    return F.array_append(
        F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.concat(F.get(out, n - 1), tail)
    )


def cut_fifty(c: Column) -> Column:
    """Pieces packed to more than 50 characters; a short last pack joins the one before."""

    def end(acc: Column) -> Column:
        # every full pack is longer than 50, so only a non-empty rest can be short
        out, rest = acc["out"], acc["buf"]
        return (
            F.when(rest == "", out)
            .when((F.size(out) > 0) & (F.length(rest) < 50), _join_last(out, rest))
            .otherwise(F.array_append(out, rest))
        )

    def group(text: Column, p: Column) -> Column:
        packed = _pack(p, lambda b: F.length(b) > 50, end)
        return F.when(F.size(p) < 2, F.array(text)).otherwise(_keep_wordy(packed))

    return let(strip_newlines(c), lambda t: let(pieces(t), lambda p: group(t, p)))


def cut_full_stops(c: Column) -> Column:
    c = F.regexp_replace(strip_newlines(c), "^。+|。+$", "")
    return _keep_wordy(F.split(c, "。"))


def cut_periods(c: Column) -> Column:
    c = F.regexp_replace(strip_newlines(c), r"^\.+|\.+$", "")
    return _keep_wordy(F.split(c, r"(?<!\d)\.(?!\d)"))


def cut_clauses(c: Column) -> Column:
    """After any clause mark, except a decimal point between digits."""
    c = strip_newlines(c)
    cls = "".join("\\" + p for p in CLAUSE_PUNCT if p != ".")
    stop = rf"(?:[{cls}]|(?<!\d)\.|\.(?!\d))"
    parts = F.regexp_extract_all(c, F.lit(rf"(?s)(?:(?!{stop}).)*{stop}|(?:(?!{stop}).)+\z"), F.lit(0))
    return _keep_wordy(parts, CLAUSE_PUNCT)


def pack_long(c: Column, limit: int = 510) -> Column:
    """Cut a long text at punctuation into packs of at most ``limit`` characters."""
    cls = "".join("\\" + p for p in SPLIT_PUNCT)
    tokens = F.regexp_extract_all(c, F.lit(f"(?s)[^{cls}]+|[{cls}]"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(acc: Column, x: Column) -> Column:
        over = F.length(acc["buf"]) + F.length(x) > limit
        return F.struct(
            F.when(over, F.array_append(acc["out"], acc["buf"])).otherwise(acc["out"]).alias("out"),
            F.when(over, x).otherwise(F.concat(acc["buf"], x)).alias("buf"),
        )

    return F.aggregate(
        tokens, start, add,
        lambda a: F.when(a["buf"] != "", F.array_append(a["out"], a["buf"])).otherwise(a["out"]),
    )


def merge_short(p: Column, threshold: int = 5) -> Column:
    """Join pieces until each has ``threshold`` characters; a rest joins the last one."""

    def end(acc: Column) -> Column:
        out, rest = acc["out"], acc["buf"]
        return (
            F.when(rest == "", out)
            .when(F.size(out) == 0, F.array(rest))
            .otherwise(_join_last(out, rest))
        )

    return let(
        p,
        lambda q: F.when(F.size(q) < 2, q).otherwise(
            _pack(q, lambda b: F.length(b) >= threshold, end)
        ),
    )


def apportion(text: Column, ratio: Column) -> Column:
    """Characters to take for a share of the time, snapped behind nearby punctuation."""
    n = F.length(text)
    raw = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * ratio, 0).cast("int")))
    reach = F.greatest(F.lit(2), F.floor(n / 4).cast("int")) - 1

    def nearest(at: Column) -> Column:
        spots = F.flatten(
            F.transform(F.sequence(F.lit(0), reach), lambda d: F.array(at - d, at + d))
        )
        good = F.filter(
            spots,
            lambda p: (p >= 1) & (p <= n - 1)
            & F.lit(CUT_PUNCT).contains(F.substring(text, p, F.lit(1))),
        )
        return F.coalesce(F.get(good, F.lit(0)), at)

    return F.when(n <= 1, n).otherwise(let(raw, nearest))


# Script ranges.
KANA = r"ぁ-ゖ゙゚ァ-ヺー"
HANGUL = r"ᄀ-ᇿ㄰-㆏가-힯"
SOFT_MARKS = r"0-9、\-〜。！？.!?… "
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DB5}\x{20000}-\x{2A6DD}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
    r"\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134A}\x{31350}-\x{323AF}\x{2EBF0}-\x{2EE5D}"
)
CJK_MARKS = r"0-9、-〜。！？.!?… /"


def all_english(c: Column) -> Column:
    """Only ASCII letters, digits and general punctuation, with at least one letter."""
    return c.rlike(
        r"\A(?=.*[A-Za-z])[A-Za-z0-9\s -~ -⁯　-〿＀-￯]+\z"
    )


def cjk_only(c: Column) -> Column:
    """The CJK characters of a text with their digits and marks."""
    return F.regexp_replace(c, f"[^{CJK}{CJK_MARKS}]", "")


def script_runs(c: Column, script: str, tag: str, other: str) -> Column:
    """Cut the runs of one script out of a text: array of (lang, text)."""
    run = f"[{script}]+(?:[{SOFT_MARKS}]+[{script}]*)*"
    parts = F.regexp_extract_all(c, F.lit(f"(?s){run}|(?:(?!{run}).)+"), F.lit(0))
    return F.transform(
        parts,
        lambda x: F.struct(
            F.when(x.rlike(f"\\A[{script}]"), tag).otherwise(other).alias("lang"), x.alias("text")
        ),
    )


_STOPS = ",.!?，。！？"

_RUN_TYPE = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())]))


def _joined(runs: Iterable[tuple[str, str]]) -> list[list]:
    """Neighbouring runs of one language as one: [lang, list of parts]."""
    out: list[list] = []
    for lang, part in runs:
        if out and out[-1][0] == lang:
            out[-1][1].append(part)
        else:
            out.append([lang, [part]])
    return out


def _inherit(runs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Digit runs, then unknown runs, take the language of a resolved neighbour.

    A digit run at the start takes the next language, at the end the one before;
    between two languages the punctuation around it decides, then the longer side.
    """
    done: list[list] = []  # [lang, parts, length]
    last = len(runs) - 1
    for i, (lang, part) in enumerate(runs):
        if lang == "digit":
            after = runs[i + 1] if i < last else None
            if not done:
                lang = after[0] if after else "zh"
            elif after is None or done[-1][0] == after[0]:
                lang = done[-1][0]
            elif done[-1][1][-1][-1] in _STOPS:
                lang = after[0]
            elif after[1][0] in _STOPS or part[-1] in "。." or done[-1][2] >= len(after[1]):
                lang = done[-1][0]
            else:
                lang = after[0]
        if done and done[-1][0] == lang:
            done[-1][1].append(part)
            done[-1][2] += len(part)
        else:
            done.append([lang, [part], len(part)])
    known = [d[0] for d in done]
    for i, lang in enumerate(known):
        if lang == "x":
            known[i] = known[i - 1] if i else (known[1] if len(known) > 1 else "zh")
    return [(g[0], "".join(g[1])) for g in _joined(zip(known, ("".join(d[1]) for d in done), strict=True))]


@F.pandas_udf(_RUN_TYPE)
def merge_runs(runs: pd.Series) -> pd.Series:
    """Join neighbouring runs of one language."""
    return runs.map(lambda rs: [
        {"lang": g[0], "text": "".join(g[1])} for g in _joined((r["lang"], r["text"]) for r in rs)])


@F.pandas_udf(_RUN_TYPE)
def resolve_runs(runs: pd.Series) -> pd.Series:
    """Merge runs and give digit and unknown runs the language of their neighbours."""

    def one(rs: Iterable[dict]) -> list[dict]:
        merged = [(g[0], "".join(g[1])) for g in _joined((r["lang"], r["text"]) for r in rs)]
        return [{"lang": a, "text": b} for a, b in _inherit(merged)]

    return runs.map(one)


def _python_class(ranges: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), ranges)


_RULES = re.compile(
    f"(?P<digit>[0-9]+)|(?P<ja>[{KANA}]+)|(?P<ko>[{HANGUL}]+)|(?P<en>[A-Za-z]+)|(?P<zh>[{_python_class(CJK)}]+)"
    f"|(?P<x>[^0-9{KANA}{HANGUL}A-Za-z{_python_class(CJK)}]+)"
)


#: languages of runs by number; a digit or unknown run has none of its own
LANGS = ("digit", "ja", "ko", "en", "zh", "x")
_DIGIT, _ZH, _UNKNOWN = 0, 4, 5
#: bytes of text whose runs are found at once; a longer text is read alone
RUN_BYTES = 1_000_000


def _kinds() -> np.ndarray:
    """The rule of every code point: its place in ``LANGS``, with 8 added where it ends a sentence or clause."""
    slot = sys.__dict__.setdefault("_clipweave_kinds", {})
    if _RULES.pattern not in slot:
        kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        for first, end in ((0, 0xD800), (0xE000, 0x110000)):
            for m in _RULES.finditer("".join(map(chr, range(first, end)))):
                kinds[first + m.start() : first + m.end()] = LANGS.index(m.lastgroup)
        kinds[[ord(c) for c in _STOPS]] |= 8
        slot[_RULES.pattern] = kinds
    return slot[_RULES.pattern]


def _resolved(kind: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray, stops: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Languages of the runs of many texts, by the rules of ``_inherit``, all texts side by side.

    ``first``, ``last``: whether a run is the first or last of its text; ``stops``, ``opens``: whether its
    last or first character is a stop. A digit run between two languages goes on if what precedes it
    ends with a stop, else back if what follows begins with one or is no longer than the group before.
    """
    n = len(kind)
    lang, at = kind.copy(), np.arange(n)
    digit = kind == _DIGIT
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    lang[digit & first & last] = _ZH
    head = digit & first & ~last
    lang[head] = after[head]
    back = digit & ~first & (last | (before == after))
    lang[back] = before[back]
    # the group before a digit run: runs of one language with digit runs between them
    open_ = digit & ~first & ~back
    goes_on = np.zeros(n, bool)  # a run that continues the group of the run before
    goes_on[1:] = (back[1:] | back[:-1]) & ~first[1:]
    begin = np.maximum.accumulate(np.where(goes_on, 0, at))
    total = np.concatenate([[0], np.cumsum(size)])
    turn = np.flatnonzero(open_)
    if len(turn):
        start = begin[turn - 1]
        least, following = total[turn] - total[start], size[turn + 1]
        # a digit run in front of the group belongs to it if that run went on
        led = ~first[start] & digit[start - 1]
        most = least + np.where(led, size[start - 1], 0)
        on = np.where(stops[turn - 1], True, np.where(opens[turn + 1] | (least >= following), False, True))
        unsure = ~stops[turn - 1] & ~opens[turn + 1] & (least < following) & (most >= following)
        # an unsure one goes back exactly if the digit run in front of its group went on
        leader_head = led & head[start - 1]
        on[unsure & leader_head] = False
        chained = unsure & led & ~leader_head
        # such a leader is the turn before, so that decisions alternate from the last sure one
        place = np.arange(len(turn))
        anchor = np.maximum.accumulate(np.where(chained, 0, place))
        on = np.where(chained, on[anchor] ^ ((place - anchor) % 2 == 1), on)
        lang[turn] = np.where(on, after[turn], before[turn])
    # unknown groups take the language before them, at the start of a text the one behind them
    fresh = first | (lang != np.roll(lang, 1))
    unknown = lang == _UNKNOWN
    group = np.flatnonzero(fresh)
    of_group, starts = lang[group], first[group]
    ends = np.roll(starts, -1)
    given = np.where(starts, np.where(ends, _ZH, np.roll(of_group, -1)), np.roll(of_group, 1))
    of_group = np.where(unknown[group], given, of_group)
    return np.repeat(of_group, np.diff(np.append(group, n)))


def _runs_of(texts: pa.Array) -> pa.Array:
    """``language_runs`` of a piece of a batch; the runs are slices of the texts' own bytes."""
    texts = pc.fill_null(texts, "")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    data = data[ends[0] : ends[-1]]
    if not len(data):
        parts, offsets = pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int32)
        langs = pa.array([], pa.string())
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each code point begins
        kinds = _kinds()[points]
        kind = kinds & 7
        border = np.empty(len(kind), bool)
        border[0] = True
        np.not_equal(kind[1:], kind[:-1], out=border[1:])
        heads = np.searchsorted(place, (ends - ends[0])[:-1][np.diff(ends) > 0])
        border[heads] = True
        at = np.flatnonzero(border)
        to = np.append(at[1:], len(kind))
        first = np.zeros(len(kind), bool)
        first[heads] = True
        first = first[at]
        stop = kinds >= 8
        lang = _resolved(kind[at], to - at, first, np.append(first[1:], True), stop[to - 1], stop[at])
        kept = np.flatnonzero(first | (lang != np.roll(lang, 1)))
        begins = np.append(place[at[kept]], len(data)).astype(np.int32)
        offsets = np.searchsorted(begins[:-1], ends - ends[0]).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(kept), [None, pa.py_buffer(begins), pa.py_buffer(data)])
        langs = pa.array(LANGS, pa.string()).take(pa.array(lang[kept]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([langs, parts], ["lang", "text"]))


def _texts_by_size(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of about ``RUN_BYTES`` bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + RUN_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


@F.arrow_udf(_RUN_TYPE)
def language_runs(texts: pa.Array) -> pa.Array:
    """Runs of a text by script rules, with digits and unknown runs resolved."""
    return pa.concat_arrays([*map(_runs_of, _texts_by_size(texts))] or [_runs_of(texts)])


_TOTAL_TYPE = T.ArrayType(T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("runs", T.LongType()), T.StructField("chars", T.LongType()),
]))


@F.arrow_udf(_TOTAL_TYPE)
def run_totals(runs: pa.Array) -> pa.Array:
    """Number of runs and code points per language of each row's runs; follows ``language_runs`` in the same worker."""
    n, made = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False), []
    so_far, at = np.cumsum(n, dtype=np.int64), 0
    while at < len(runs):  # about ``RUN_BYTES`` runs at once
        to = max(at + 1, int(np.searchsorted(so_far, (so_far[at - 1] if at else 0) + RUN_BYTES, side="right")))
        made.append(_totals_of(runs.slice(at, to - at), n[at:to]))
        at = to
    return pa.concat_arrays(made or [_totals_of(runs, n)])


def _totals_of(runs: pa.Array, n: np.ndarray) -> pa.Array:
    flat = runs.flatten()
    coded = flat.field("lang").dictionary_encode()
    names, cells = coded.dictionary, len(runs) * len(coded.dictionary)
    cell = np.repeat(np.arange(len(runs)) * len(names), n) + coded.indices.to_numpy(zero_copy_only=False)
    count = np.bincount(cell, minlength=cells)
    chars = np.bincount(cell, pc.utf8_length(flat.field("text")).to_numpy(zero_copy_only=False), minlength=cells)
    kept = np.flatnonzero(count)
    ends = np.searchsorted(kept, np.arange(len(runs) + 1) * len(names)).astype(np.int32)
    parts = [names.take(pa.array(kept % max(1, len(names)))), pa.array(count[kept].astype(np.int64)), pa.array(chars[kept].astype(np.int64))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["lang", "runs", "chars"]))


def pre_segment(c: Column, method: str = "cut5", lang: str = "zh") -> Column:
    """Prepare a text for line-wise work: cut, merge short lines, end and pack them."""
    from clipweave.functions.registry import segmentation

    cls = "".join("\\" + p for p in SPLIT_PUNCT)
    stop = "。" if lang != "en" else "."

    def lead(t: Column) -> Column:
        first = strip(F.regexp_extract(t, f"(?s)^[^{cls}]*", 0))
        short = ~t.rlike(f"^[{cls}]") & (F.length(first) < 4)
        return F.when(short, F.concat(F.lit(stop), t)).otherwise(t)

    def lines(t: Column) -> Column:
        cut = segmentation(method)(lead(t))
        flat = F.split(F.regexp_replace(F.array_join(cut, "\n"), r"\n{2,}", "\n"), "\n")
        kept = merge_short(F.filter(flat, lambda x: ~x.isin("", " ", "\n")), 5)
        wordy = F.filter(kept, lambda x: ~is_blank(x) & x.rlike(r"(?U)\w"))
        ended = F.transform(
            wordy, lambda x: F.when(x.rlike(f"[{cls}]$"), x).otherwise(F.concat(x, F.lit(stop)))
        )
        return F.flatten(
            F.transform(ended, lambda x: F.when(F.length(x) > 510, pack_long(x)).otherwise(F.array(x)))
        )

    return let(
        strip_newlines(c),
        lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(lines(t)),
    )
