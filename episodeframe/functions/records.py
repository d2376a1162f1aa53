"""Nested records and answers: chat rows, contexts, boards as text, canonical forms, scores."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Moves in their tie order and what undoes them; symbols of a board, letters of actors (fixed values).
MOVES = ("U", "D", "L", "R")
UNDO = ("UDLR", "DURL")
SYMBOLS = "#.o -?PGVE"
LETTERS = "PGVE"


def first_text(messages: Column, role: str) -> Column:
    """The text of the first message of a role (role, parts of type and text): its text parts that are not empty, joined by line feeds."""
    found = F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["parts"]
    texts = F.transform(F.filter(found, lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def known_answer(answer: Column, allowed: tuple[str, ...], where: Column) -> Column:
    """The answer trimmed and in lower case; one that is not allowed is an error that names the row."""
    plain = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(plain.isin(*allowed), plain).otherwise(F.raise_error(F.concat(F.lit("invalid answer of row "), where.cast("string"))))


def exit_counts(history: Column, moves: tuple[str, ...] = MOVES) -> Column:
    """{move: times} of the moves that a history holds."""
    times = lambda m: F.size(F.filter(history, lambda h: h == m))
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(m).alias("key"), times(m).alias("value")) for m in moves)), lambda e: e["value"] > 0))


def preferred_moves(open_: Column, tried: Column, last: Column) -> Column:
    """Of the open moves those never tried, else those tried least; the one that undoes the last move is left out unless it is the only one."""
    times = lambda m: F.size(F.filter(tried, lambda t: t == m))
    least = F.array_min(F.transform(open_, times))
    best = F.filter(open_, lambda m: times(m) == least)
    undo = F.translate(F.coalesce(last, F.lit("")), *UNDO)
    without = F.filter(best, lambda m: m != undo)
    return F.when(F.size(without) > 0, without).otherwise(best)


def legal_action(flag: Column, observation: Column, action: Column) -> Column:
    """The recorded flag; else whether the `Legal actions:` line of the observation lists the action; true without either."""
    line = F.regexp_extract(observation, "(?m)^Legal actions:(.*)$", 1)
    has = observation.rlike("(?m)^Legal actions:")
    listed = F.array_contains(F.transform(F.split(line, ","), lambda x: F.trim(x)), action)
    return F.coalesce(flag, F.when(has, listed), F.lit(True))


def verified_win(won: Column, reason: Column, remaining: Column, events: Column) -> Column:
    """All four kinds of evidence: the flag, the terminal reason, nothing remaining, and a level_cleared event in some step's list."""
    seen = F.exists(F.flatten(events), lambda e: e == "level_cleared")
    return F.coalesce(won & (reason == "all_normal_pellets") & (remaining == 0) & seen, F.lit(False))


def _in_canon(text: str | None) -> str | None:
    """A JSON text printed anew: keys sorted, no blanks, non-ASCII escaped, floats as short as they can be; none for what is no JSON."""

    def number(digits: str) -> float:
        return float(digits) + 0.0  # one zero

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.dumps(json.loads(text, parse_float=number, parse_constant=refuse), sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


def canonical_text(text: Column) -> Column:
    """Any JSON text in canonical form, whatever the order of its keys; 1, 1.0 and true stay apart. Null for text that is no JSON (NaN is none)."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(map(_in_canon, texts.to_pylist()), pa.string())

    return run(text)


def canonical_json(**values: Column) -> Column:
    """An object in canonical form; nulls are kept."""
    return canonical_text(F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"}))


def fingerprint(text: Column) -> Column:
    """SHA-256 of a JSON text's canonical form; null for text that is no JSON."""
    return F.sha2(canonical_text(text), 256)


def same_typed(a: Column, b: Column) -> Column:
    """Whether two JSON texts say the same, types included: their canonical forms are equal. False where one is no JSON."""
    return F.coalesce(canonical_text(a) == canonical_text(b), F.lit(False))


def literal_metrics(text: Column) -> Column:
    """The namespaced finite numbers of a Python dict literal, as a map, the last of equal keys; null where the text is no dict of scalars and
    flat lists. Names such as nan, inf, True and None are values, but no numbers."""
    string = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    flat = r"[\[({][^\[\](){}]*[\])}]"
    pair = rf"({string}|{number})\s*:\s*({string}|{number}|[-+]?[A-Za-z_]+|{flat})"
    whole = rf"(?s)^\s*\{{\s*(?:{pair}(?:\s*,\s*{pair})*\s*,?\s*)?\}}\s*$"
    found = lambda group: F.regexp_extract_all(text, F.lit(pair), F.lit(group))
    entry = lambda k, v: F.struct(F.substring(k, F.lit(2), F.length(k) - 2).alias("key"), F.when(v.rlike(f"^{number}$"), v.try_cast("double")).alias("value"))
    every = F.zip_with(found(1), found(2), entry)
    named = F.filter(every, lambda e: F.contains(e["key"], F.lit("/")) & e["value"].isNotNull())
    # a lambda's variable is made once: the expression itself, inside the filter, would search the text again for each entry
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"]))
    return F.when(text.rlike(whole), F.map_from_entries(F.get(F.transform(F.array(named), last), F.lit(0))))



def hash_order(ids: Column, key: Column, domain: str) -> Column:
    """ids in the order of SHA-256 of key, domain and id joined by colons."""
    tagged = F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.struct(F.sha2(F.concat_ws(":", key, F.lit(domain), i), 256).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda t: t["i"])


def shuffled_codes(ids: Column, key: Column, alphabet: tuple[str, ...]) -> Column:
    """{id: code}: the ids in plain order get the codes in hash order."""
    plain = F.array_sort(F.array_distinct(ids))
    codes = hash_order(F.array(*map(F.lit, alphabet)), key, "code")
    return F.map_from_arrays(plain, F.slice(codes, F.lit(1), F.size(plain)))


def decoded_option(code: Column, codes: Column, ids: Column) -> Column:
    """The id whose code it is; a code that is not offered is an error."""
    at = F.array_position(codes, code)
    return F.when(at > 0, F.get(ids, (at - 1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("not an offered code: "), F.coalesce(code, F.lit("null")))))


def packed_rows(rows: Column) -> Column:
    """Rows of symbols with single blanks between them, without these blanks."""
    return F.transform(rows, lambda r: F.regexp_replace(r, "(.) (?=.)|(.)$", "$1$2"))


def spaced_rows(rows: Column) -> Column:
    """Rows of symbols with a single blank between neighbours."""
    return F.transform(rows, lambda r: F.regexp_replace(r, "(.)(?=.)", "$1 "))


def decoded_board(rows: Column, height: Column, width: Column) -> Column:
    """The packed rows of a spaced board of exact size and known symbols; null otherwise."""
    packed = packed_rows(rows)
    sized = F.forall(rows, lambda r: (F.length(r) == 2 * width - 1) & r.rlike("^.( .)*$"))
    known = F.forall(packed, lambda r: F.length(F.translate(r, SYMBOLS, "")) == 0)
    return F.when((F.size(rows) == height) & sized & known, packed)


def cells(rows: Column) -> Column:
    """All symbols of packed rows, in reading order."""
    return F.split(F.array_join(rows, ""), "")


def letters(rows: Column) -> Column:
    text = F.array_join(rows, "")
    return F.length(text) - F.length(F.translate(text, LETTERS, ""))


def board_score(pred: Column, truth: Column, width: Column, actors: Column) -> dict[str, Column]:
    """Scores of a decoded board (null: invalid) against the truth, with actors (symbol, cell, box of cells; cells count in reading order).

    exact, right cells, and the tolerant score: all cells outside the boxes right, every shown actor found in its box, as many letters as in the truth.
    """
    p, t = cells(pred), cells(truth)
    total = F.size(t)
    right = F.size(F.filter(F.zip_with(p, t, lambda x, y: x == y), lambda x: x))
    zone = F.array_distinct(F.flatten(F.transform(actors, lambda a: a["box"])))
    outside = F.forall(F.sequence(F.lit(0), total - 1), lambda i: F.array_contains(zone, i) | (F.get(p, i) == F.get(t, i)))
    shown = F.filter(actors, lambda a: F.get(t, a["cell"]) == a["symbol"])
    found = F.filter(shown, lambda a: F.exists(a["box"], lambda i: F.get(p, i) == a["symbol"]))
    valid = pred.isNotNull()
    no = lambda c: F.coalesce(valid & c, F.lit(False))
    return {
        "valid": valid,
        "exact": no(p == t),
        "cell_correct": F.when(valid, right).otherwise(0).cast("long"),
        "cell_total": total.cast("long"),
        "actors_found": F.when(valid, F.size(found)).otherwise(0).cast("long"),
        "exact_tolerant": no(outside & (F.size(found) == F.size(shown)) & (letters(pred) == letters(truth))),
    }


def neighbours(rows: Column, r: Column, c: Column) -> dict[str, Column]:
    """What lies above, below, left and right of a cell: wall (also beyond the board), door, unknown or open."""
    kinds = {}
    for name, dr, dc in (("U", -1, 0), ("D", 1, 0), ("L", 0, -1), ("R", 0, 1)):
        row = F.when((r + dr >= 0) & (c + dc >= 0), F.get(rows, (r + dr).cast("int")))
        symbol = F.substring(row, (c + dc + 1).cast("int"), F.lit(1))
        kinds[name] = F.when(symbol.isNull() | (symbol == "") | (symbol == "#"), "wall").when(symbol == "-", "door").when(symbol == "?", "unknown").otherwise("open")
    return kinds


def region_count(rows: Column, r: Column, c: Column, radius: int, symbol: str) -> Column:
    """How often a symbol stands within `radius` rows and columns of a cell, inside the board."""
    top, left = F.greatest(r - radius, F.lit(0)), F.greatest(c - radius, F.lit(0))
    part = F.array_join(F.transform(F.slice(rows, (top + 1).cast("int"), (r + radius - top + 1).cast("int")), lambda x: F.substring(x, (left + 1).cast("int"), (c + radius - left + 1).cast("int"))), "")
    return (F.length(part) - F.length(F.replace(part, F.lit(symbol), F.lit("")))).cast("long")


def overlaid(rows: Column, actors: Column) -> Column:
    """Packed rows with the actors' symbols (symbol, r, c, pixels): of several in one cell the one that shows most pixels, the first on a tie."""
    at = F.sequence(F.lit(1), F.size(actors))
    numbered = F.zip_with(actors, at, lambda a, i: F.struct(a["r"].alias("r"), a["c"].alias("c"), (-a["pixels"]).alias("p"), i.alias("i"), a["symbol"].alias("symbol")))

    def row(text: Column, r: Column) -> Column:
        own = F.filter(numbered, lambda a: a["r"] == r)
        one = lambda ch, c: F.coalesce(F.get(F.array_sort(F.filter(own, lambda a: a["c"] == c)), F.lit(0))["symbol"], ch)
        return F.array_join(F.transform(F.split(text, ""), one), "")

    return F.transform(rows, row)


def layout_hash(rows: Column) -> Column:
    return F.sha2(F.array_join(rows, "\n"), 256)


def topology_hash(rows: Column) -> Column:
    """The hash of the walls alone."""
    return layout_hash(F.transform(rows, lambda r: F.regexp_replace(r, "[^#]", " ")))


def common_prefix_of(rows: Column, block: int = 64) -> Column:
    """Length, in whole blocks, of the longest prefix that all arrays of an array share."""
    first = F.get(rows, F.lit(0))
    least = F.array_min(F.transform(rows, F.size))
    places = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    off = F.filter(places, lambda i: ~F.forall(rows, lambda r: F.get(r, i).eqNullSafe(F.get(first, i))))
    n = F.coalesce(F.get(off, F.lit(0)), least)
    return (n - n % block).cast("long")


def overlapping(boxes: Column, size: int) -> Column:
    """Whether two boxes (y, x) of an array lie nearer than `size` on both axes."""
    n = F.size(boxes)
    return F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.exists(F.slice(boxes, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: (F.abs(b["y"] - F.get(boxes, i)["y"]) < size) & (F.abs(b["x"] - F.get(boxes, i)["x"]) < size)))


def spread_picks(steps: Column, gap: int) -> Column:
    """Of ascending steps those at least `gap` after the last one picked: the first, and so on."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(steps, start, lambda acc, s: F.when((F.size(acc) == 0) | (s - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(s))).otherwise(acc))
