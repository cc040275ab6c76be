"""Compatibility normalisation (NFKC) and full case folding as Column expressions.

Tables come from ``unicodedata`` by rule and enter the plan as one folded literal each. A text without
a character that expands or that may combine with the one before is translated at once; any other is cut into
runs that are translated and into short segments, each a character with what may combine with it, that are decomposed,
reordered by combining class and composed. A segment never combines with the next, so cuts lose nothing.
Null stays null, the empty text stays empty. Unassigned characters and lone ones of any kind keep themselves.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
FAN = 6
FEW = 48
BEYOND = r"[^\x{0}-\x{7f}]"
# Hangul syllables are composed by arithmetic: first syllable, first leading, vowel and trailing letter, and their numbers.
S, L, V, T, LS, VS, TS = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28
CODES = (*range(0xD800), *range(0xE000, 0x110000))
# Python's white space.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def is_syllable(code: int) -> bool:
    return S <= code < S + LS * VS * TS


def char_class(codes: Iterable[int]) -> str:
    """A regular expression's character class, as a tree of ranges: a character is held against few of them."""
    ranges: list[list[int]] = []
    for c in sorted(codes):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])

    def tree(part: list[list[int]]) -> str:
        if len(part) <= FAN:
            return "".join(rf"\x{{{x:x}}}-\x{{{y:x}}}" for x, y in part)
        size = -(-len(part) // FAN)
        return "".join(rf"[\x{{{q[0][0]:x}}}-\x{{{q[-1][1]:x}}}&&[{tree(q)}]]" for q in (part[i : i + size] for i in range(0, len(part), size)))

    return f"[{tree(ranges)}]"


@cache
def tables() -> dict:
    """decomposed, classes and pairs (starter: alternately second and composed) by code point; ``folds``: full case folding; ``settled``: the form of a character alone; ``joins``: may combine with what is before; ``wide``: expand; ``one``: become one other character."""
    decomposed, classes, folds, pairs = {}, {}, {}, {}
    for i in CODES:
        c = chr(i)
        d = c if is_syllable(i) else unicodedata.normalize("NFKD", c)
        if d != c:
            decomposed[i] = d
        if k := unicodedata.combining(c):
            classes[i] = k
        if (f := c.casefold()) != c:
            folds[i] = f
        canonical = unicodedata.decomposition(c)
        if canonical and "<" not in canonical and " " in canonical:
            a, b = (chr(int(x, 16)) for x in canonical.split())
            if unicodedata.normalize("NFC", a + b) == c:
                pairs[ord(a)] = pairs.get(ord(a), "") + b + c
    seconds = {ord(b) for x in pairs.values() for b in x[::2]} | set(range(V, V + VS)) | set(range(T + 1, T + TS))
    assert not seconds & {ord(c) for x in pairs.values() for c in x[1::2]}  # so a search in a list of pairs can't hit the wrong half
    joins = {i for i in CODES if (f := ord(decomposed.get(i, chr(i))[0])) in seconds or f in classes}
    settled = {i: unicodedata.normalize("NFKC", chr(i)).casefold() for i in {*decomposed, *folds}}
    wide = {i for i, s in settled.items() if len(s) > 1}
    one = {chr(i): s for i, s in settled.items() if len(s) == 1 and i not in joins and s != chr(i)}
    return {"decomposed": decomposed, "classes": classes, "pairs": pairs, "folds": folds, "settled": settled, "joins": joins, "wide": wide - joins, "one": one}


def looked_up(table: dict[int, str | int]) -> Callable[[Column], Column]:
    """The table's value for a character, else null: two steps through arrays, whatever the table's size."""
    blocks = sorted({i // BLOCK for i in table})
    number = {b: i for i, b in enumerate(blocks)}
    kind = "int" if isinstance(next(iter(table.values())), int) else "string"
    literal = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>")
    index = literal([number.get(b) for b in range(blocks[-1] + 1)], "int")
    values = literal([table.get(b * BLOCK + i) for b in blocks for i in range(BLOCK)], kind)

    def get(char: Column) -> Column:
        return bound(F.ascii(char), lambda code: F.get(values, F.get(index, F.shiftright(code, 6)) * BLOCK + code.bitwiseAND(BLOCK - 1)))

    return get


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def characters(text: Column) -> Column:
    return F.split(text, "")


def replaced(text: Column, table: dict[int, str]) -> Column:
    """Every character by the table's value, if there is one."""
    get = looked_up(table)
    return F.array_join(F.transform(characters(text), lambda c: F.coalesce(get(c), c)), "")


def translated(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def composed(segment: Column) -> Column:
    """NFKC of one segment."""
    t = tables()
    combining, partners = looked_up(t["classes"]), looked_up(t["pairs"])
    marks, others = char_class(t["classes"]), char_class(set(CODES) - set(t["classes"]))
    flat = replaced(segment, t["decomposed"])
    runs = F.regexp_extract_all(flat, F.lit(f"{others}{marks}*+|{marks}++"), F.lit(0))
    member = lambda c, i: F.struct(F.coalesce(combining(c), F.lit(0)).alias("k"), i.alias("i"), c.alias("c"))
    ordered = F.flatten(F.transform(runs, lambda r: F.array_sort(F.transform(characters(r), member))))

    empty = F.lit("")

    def state(done, starter, tail, last):
        return F.struct(done.alias("done"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))

    def joined(a: Column, b: Column) -> Column:
        """The one character that a and b make, else null."""
        x, y = F.ascii(a), F.ascii(b)
        syllable = F.when(x.between(L, L + LS - 1) & y.between(V, V + VS - 1), F.lit(S) + ((x - L) * VS + y - V) * TS)
        syllable = syllable.when(x.between(S, S + LS * VS * TS - 1) & ((x - S) % TS == 0) & y.between(T + 1, T + TS - 1), x + y - T)
        pair = bound(partners(a), lambda found: bound(F.instr(found, b), lambda at: F.when(at > 0, F.substring(found, at + 1, F.lit(1)))))
        return F.coalesce(pair, F.when(a != "", bound(syllable, character)))

    def step(s: Column, m: Column) -> Column:
        free = (s["starter"] != "") & ((s["tail"] == "") | (s["last"] < m["k"]))
        return bound(
            F.when(free, joined(s["starter"], m["c"])),
            lambda whole: F.when(whole.isNotNull(), state(s["done"], F.coalesce(whole, empty), s["tail"], s["last"]))
            .when(m["k"] == 0, state(F.concat(s["done"], s["starter"], s["tail"]), m["c"], empty, F.lit(0)))
            .otherwise(state(s["done"], s["starter"], F.concat(s["tail"], m["c"]), m["k"])),
        )

    return F.aggregate(ordered, state(empty, empty, empty, F.lit(0)), step, lambda s: F.concat(s["done"], s["starter"], s["tail"]))


def character(code: Column) -> Column:
    """The character of a code point from U+0800 to U+FFFF, by its three UTF-8 bytes."""
    part = lambda c, high: F.hex(c.bitwiseAND(63).bitwiseOR(high) if high == 128 else c.bitwiseOR(high))
    return F.decode(F.unhex(F.concat(part(F.shiftright(code, 12), 0xE0), part(F.shiftright(code, 6), 128), part(code, 128))), "UTF-8")


@cache
def patterns() -> tuple[str, str, str]:
    """Whether a text needs more than a translation, its pieces, and which pieces are no runs."""
    t = tables()
    joins, odd, plain = char_class(t["joins"]), char_class(t["joins"] | t["wide"]), char_class(set(CODES) - t["joins"] - t["wide"])
    return odd, f"(?s){plain}+(?!{joins})|.{joins}*+", rf"(?s)\A(?:{odd}|.{joins})"


def folded(text: Column) -> Column:
    """The case-folded NFKC form of a text."""
    t = tables()
    one, alone = t["one"], looked_up(t["settled"])
    odd, piece, segment = patterns()
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    run = lambda p: F.when(p.rlike(BEYOND), translated(p, one)).otherwise(F.lower(p))
    short = lambda p: F.when(F.length(p) == 1, F.coalesce(alone(p), p)).otherwise(replaced(composed(p), t["folds"]))
    form = lambda p: F.when(p.rlike(segment), short(p)).otherwise(run(p))

    def parts(ps: Column) -> Column:
        """Forms of the pieces. A text repeats its segments: if different ones are few, each is formed once and looked up."""
        odd_ones = F.array_distinct(F.filter(ps, lambda p: p.rlike(segment)))
        few = lambda own: F.size(own) <= FEW

        def found(own: Column) -> Column:
            named = lambda forms: bound(F.map_from_arrays(own, forms), lambda m: F.transform(ps, lambda p: F.coalesce(F.try_element_at(m, p), run(p))))
            return bound(F.transform(F.when(few(own), own).otherwise(ps), form), lambda forms: F.when(few(own), named(forms)).otherwise(forms))

        return bound(odd_ones, found)

    return F.when(text.rlike(odd), F.array_join(bound(pieces, parts), "")).otherwise(run(text))


@cache
def dropped(kept: str = "") -> str:
    """Runs of what is neither letter nor number by ``str.isalnum``, nor in kept."""
    return char_class(i for i in CODES if not chr(i).isalnum() and chr(i) not in kept) + "++"


def letters(text: Column, kept: str = "") -> Column:
    """The letters and numbers of a text, and the ASCII characters in kept."""
    return F.when(text.rlike(BEYOND), F.regexp_replace(text, dropped(kept), "")).otherwise(F.regexp_replace(text, f"[^A-Za-z0-9{kept}]++", ""))


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))
