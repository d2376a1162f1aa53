"""Hashes, parsing and small rules as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores at which a life is awarded (fixed values).
LIFE_AWARDS = (25_000, 50_000, 100_000, 150_000)
ANSI = "\x1b\\[[0-9;]*m"
#: Moves as words, in their tie order, and settings whose values are not shown (fixed values).
WORDS = ("up", "down", "left", "right", "stay")
SECRET = "(?i)api.?key|wandb.key|password|secret|access.?token|authorization"
HIDDEN = "[REDACTED]"
REPEATED = " \\[repeated \\d+x across cluster\\]$"


def seed32(text: Column) -> Column:
    """The first four bytes of the SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def seed64_little(text: Column) -> Column:
    """The first eight bytes of the SHA-256, little-endian, as a decimal that holds them all."""
    h = F.sha2(text, 256)
    swapped = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def distance_bucket(x: Column) -> Column:
    """Bands of a distance; null counts as far."""
    return F.when(x <= 2, "0-2").when(x <= 5, "3-5").otherwise("6+")


def pellet_bucket(x: Column) -> Column:
    return F.when(x <= 10, "0-10").when(x <= 40, "11-40").otherwise("41+")


def bucket_key(row: Column, col: Column, distance: Column, pellets: Column) -> Column:
    """The 4 x 4 block of the board, the band of the distance and the band of what is left, joined by bars."""
    return F.concat_ws("|", F.floor(row / 4).cast("string"), F.floor(col / 4).cast("string"), distance_bucket(distance), pellet_bucket(pellets))


def tier_label(wins: Column, episodes: Column) -> Column:
    """blocked without a win, very_easy if all are won, else mixed."""
    return F.when(wins == 0, "blocked").when(wins == episodes, "very_easy").otherwise("mixed")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\p{L}\\p{N}_-]", "_")


def clean_line(line: Column) -> Column:
    """A log line without colours and repeat notes."""
    return F.regexp_replace(F.regexp_replace(line, ANSI, ""), REPEATED, "")


def _object_action(text: Column, allowed: tuple[str, ...]) -> Column:
    """The first allowed `action` of a JSON object that starts anywhere in the text, lower-cased; null if there is none."""

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def first(text: str | None) -> str | None:
            at = text.find("{") if text else -1
            while at >= 0:
                try:
                    found, _ = decoder.raw_decode(text[at:])
                except ValueError:
                    found = None
                if isinstance(found, dict) and str(found.get("action", "")).strip().lower() in allowed:
                    return str(found["action"]).strip().lower()
                at = text.find("{", at + 1)
            return None

        return texts.map(first)

    return scan(F.when(text.contains("{"), text))  # other rows carry no text to Python


def parsed_action(text: Column, allowed: tuple[str, ...] = WORDS, by_word: bool = True, fallback: str | None = None) -> Column:
    """A move from an answer: the whole text, a JSON object's `action`, an `action:` line, a `final answer:` line, any word.

    A stage's find counts only if it is allowed. Without any, it is `fallback`; by default `stay` or
    else the first allowed word.
    """
    lower = F.lower(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    word = "(" + "|".join(WORDS) + ")"
    ok = lambda c: F.when(c.isin(*allowed), c)
    line = F.regexp_extract(lower, f"(?:^|\\n)\\s*(?:final\\s+)?action\\s*[:=]\\s*{word}\\b", 1)
    final = F.regexp_extract(lower, f"(?:^|\\n)\\s*final\\s+answer\\s*[:=]\\s*{word}\\b", 1)
    words = F.filter(F.regexp_extract_all(lower, F.lit(f"\\b{word}\\b"), F.lit(1)), lambda w: w.isin(*allowed))
    last = fallback or ("stay" if "stay" in allowed else next((w for w in WORDS if w in allowed), "stay"))
    return F.coalesce(ok(lower), _object_action(text, allowed), ok(line), ok(final), *([F.get(words, F.lit(0))] if by_word else []), F.lit(last))


def lives_after(lives: Column, before: Column, after: Column, died: Column) -> Column:
    """Lives after a step: awards between the scores come in, a death takes one, never below 0."""
    won = sum((F.when((before < t) & (after >= t), 1).otherwise(0) for t in LIFE_AWARDS), F.lit(0))
    return F.greatest(F.lit(0), lives + won - died.cast("int"))


def common_prefix(a: Column, b: Column, block: int = 64) -> Column:
    """Length of the common prefix of two arrays, in whole blocks."""
    differs = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differs, F.lit(True))
    n = F.when(first > 0, first - 1).otherwise(F.size(differs))
    return (n - n % block).cast("long")


def warmup_cosine(step: Column, warmup: int, total: int, peak: float) -> Column:
    rise = peak * (step + 1) / warmup
    fall = peak * 0.5 * (1 + F.cos(F.pi() * (step - warmup) / (total - warmup)))
    return F.when(step < warmup, rise).otherwise(fall)


def redacted(settings: Column, pattern: str = SECRET) -> Column:
    """A map whose secret values are hidden."""
    return F.transform_values(settings, lambda k, v: F.when(k.rlike(pattern), F.lit(HIDDEN)).otherwise(v))


def redacted_arguments(argv: Column, pattern: str = SECRET) -> Column:
    """Command-line arguments: `--name=value` with a secret name keeps the name, and what follows a secret `--name` is hidden."""
    secret = lambda v: v.startswith("--") & F.split_part(v, F.lit("="), F.lit(1)).rlike(pattern)

    def shown(state: Column, v: Column) -> Column:
        hide, out = state["hide"], state["out"]
        new = F.when(hide, F.lit(HIDDEN)).when(secret(v) & v.contains("="), F.concat(F.split_part(v, F.lit("="), F.lit(1)), F.lit("=" + HIDDEN))).otherwise(v)
        return F.struct((~hide & secret(v) & ~v.contains("=")).alias("hide"), F.concat(out, F.array(new)).alias("out"))

    start = F.struct(F.lit(False).alias("hide"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(argv, start, shown, lambda s: s["out"])


def metrics_only(values: Column) -> Column:
    """Entries with a namespaced key and a finite number."""
    return F.map_filter(values, lambda k, v: k.contains("/") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
