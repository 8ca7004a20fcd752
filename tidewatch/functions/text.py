"""Column functions over message text."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidewatch.functions import values as V


def word_set(text: Column) -> Column:
    """Distinct lower-case words of more than two characters, punctuation removed (letters and digits of any script kept)."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2))


def places_of(words: Column) -> Column:
    """The distinct places, of 65,536, that the words of a set fall into: a sign of two bytes a word."""
    return F.array_distinct(F.transform(words, lambda w: (F.hash(w).bitwiseAND(F.lit(0xFFFF)) - 32768).cast("short")))


def similar(a: Column, b: Column) -> Column:
    """Jaccard similarity strictly above 0.4, on integers; an empty side is like nothing."""
    return 5 * F.size(F.array_intersect(a, b)) > 2 * F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def once(value: Column, use) -> Column:
    """use(value), with value evaluated one time, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(text: Column, phrases) -> Column:
    """Whether text contains one of the phrases (plain substrings): an or of searches, which stops at the first hit."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def one_of(text: Column, phrases: Iterable[str]) -> Column:
    """What any_of says, by one automaton over the text in Python instead of a search for each phrase."""
    pattern = "|".join(map(re.escape, phrases))

    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    found.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # Spark reads types, not their names
    return F.arrow_udf(found, BooleanType())(text)


def is_noise(text: Column, severity: Column | None = None) -> Column:
    """Too short, a noise phrase, a short comment, or of measured low severity. An unmeasured severity never decides."""
    noise = once(stripped(text), lambda s: once(F.lower(s), lambda low: once(_words_at_most(s, V.SHORT_WORDS + 1), lambda n: _short(s, n) | any_of(low, V.NOISE_PHRASES) | _comment(low, n))))
    return noise if severity is None else noise | low_severity(severity)


def without_noise(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is no noise, as is_noise has it, with all phrases looked for at once: for many long texts."""
    low = F.lower(stripped(F.col(text)))
    brief = once(stripped(F.col(text)), lambda s: once(_words_at_most(s, V.SHORT_WORDS + 1), lambda n: _short(s, n) | _comment(F.lower(s), n)))
    return rows.filter(~brief).filter(~one_of(low, V.NOISE_PHRASES))


def stripped(text: Column) -> Column:
    """The text without white space at its ends; null as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(V.WHITE))


def _words_at_most(stripped: Column, most: int) -> Column:
    """How many words a text has, counted up to most (one or more); its beginning is looked at first."""
    count = lambda x: F.size(F.split(x, r"(?U)\s+", most))
    return F.when(count(F.substring(stripped, 1, 16 * most)) >= most, most).otherwise(count(stripped))


def _short(stripped: Column, words: Column) -> Column:
    return (F.length(stripped) < V.MIN_CHARS) | (words < V.MIN_WORDS)


def _comment(low: Column, words: Column) -> Column:
    first = F.regexp_replace(F.regexp_extract(low, r"(?U)^(\S+)", 1), "[.,!?]+$", "")
    two = F.regexp_replace(F.regexp_replace(F.regexp_extract(low, r"(?U)^(\S+(?:\s+\S+)?)", 1), r"(?U)\s+", " "), "[.,!?]+$", "")
    starts = F.lit(False)
    for s in V.COMMENTARY_STARTERS:
        starts = starts | (first == s) | two.startswith(s)
    return (words <= V.SHORT_WORDS) & starts


def low_severity(severity: Column) -> Column:
    return F.coalesce(severity < V.MIN_SEVERITY, F.lit(False))


def is_relevant(title: Column, description: Column) -> Column:
    return once(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))), lambda low: any_of(low, V.CONFLICT_KEYWORDS))


def quoted(name: Column) -> Column:
    """A pattern that matches name literally."""
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def evidence_span(raw: Column, name: Column, no_places=V.NOT_A_PLACE) -> Column:
    """Where raw spells the location name, as raw has it; empty when no place is named (a name of no_places) or it is not spelled."""
    place = F.trim(F.coalesce(name, F.lit("")))
    found = F.call_function("regexp_extract", raw, F.concat(F.lit(r"(?iU)\b"), quoted(place), F.lit(r"\b")), F.lit(0))
    return F.when(raw.isNull() | (raw == "") | F.lower(place).isin(*no_places), F.lit("")).otherwise(found)


def strip_reply(reply: Column) -> Column:
    """A model's reply without its thinking block and code fence."""
    bare = F.trim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)^```[a-zA-Z]*\s*", ""), r"(?s)\s*```$", ""))


def clean_location(name: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*V.NOT_A_PLACE), F.lit("Unknown")).otherwise(F.trim(name))


def reply_fields(reply: Column) -> Column:
    """A classification reply as a struct: status (ok or parse_failed), event_type, severity, killed_reported,
    location_name, summary, is_noise. Severity must be a number from 1 to 10 and killed, if given, from 0 to a
    million; booleans are refused, quoted numbers taken, nothing is clamped."""
    v = F.try_parse_json(strip_reply(reply))
    shape = F.schema_of_variant(v)

    def number(path: str) -> tuple[Column, Column, Column]:
        raw = F.try_variant_get(v, path, "string")
        is_bool = F.get_json_object(strip_reply(reply), path).isin("true", "false") & ~F.contains(strip_reply(reply), F.concat(F.lit('"'), raw, F.lit('"')))
        value = F.when(raw.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.trim(raw).try_cast("double").try_cast("long"))
        return raw, F.coalesce(is_bool, F.lit(False)), value

    sev_raw, sev_bool, sev = number("$.severity")
    kill_raw, kill_bool, kill = number("$.killed_reported")
    ok = shape.startswith("OBJECT") & ~sev_bool & ~kill_bool & F.coalesce(sev.between(1, 10), F.lit(False)) & (kill_raw.isNull() | F.coalesce(kill.between(0, V.MAX_KILLED), F.lit(False)))
    ok = F.coalesce(ok, F.lit(False))
    kind = F.try_variant_get(v, "$.event_type", "string")
    summary = F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(""))
    return F.struct(
        F.when(ok, "ok").otherwise("parse_failed").alias("status"),
        F.when(ok, F.when(kind.isin(*V.EVENT_TYPES), kind).otherwise(V.EVENT_TYPES[0])).alias("event_type"),
        F.when(ok, sev).alias("severity"),
        F.when(ok, kill).alias("killed_reported"),
        F.when(ok, clean_location(F.coalesce(F.try_variant_get(v, "$.location_name", "string"), F.lit("Unknown")))).alias("location_name"),
        F.when(ok, summary).alias("summary"),
        F.when(ok, (summary == "[NOISE]") | (sev <= 1)).alias("is_noise"),
    )


def url_key(url: Column) -> Column:
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 16)


def message_url(channel: Column, message_id: Column) -> Column:
    return F.concat(F.lit("https://t.me/"), F.ltrim(channel, F.lit("@")), F.lit("/"), message_id.cast("string"))


def feed_time(x: Column) -> Column:
    """RFC 822 or ISO 8601 time; null when neither reads."""
    bare = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3,9},\s*", "")
    zone = F.regexp_replace(bare, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(x))


def window_of(text: Column, pattern: str, before: int = 60, after: int = 60) -> Column:
    """Text around the first match of a pattern, for audits; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substr(text, F.greatest(at - before, F.lit(1)), F.lit(before + after)))


def toll_bucket(text: Column) -> Column:
    """How a text states a death toll: by one of the counting phrases (the first that fits), near a number in Arabic, of
    one described person, as zero, as not yet published, by the wounded alone, or not at all (none; null text: null).

    That nobody was killed is a measurement; that no deaths were announced is none. Patterns are looked for only in texts that have a
    stem of theirs."""

    def of(low: Column) -> Column:
        return once(any_of(low, V.TOLL_WORDS), lambda english: bucket(low, english))

    def bucket(low: Column, english: Column) -> Column:
        out = F.when(text == "", F.lit(None))
        for name, pattern in V.TOLL_COUNTS.items():
            out = out.when(english & text.rlike(pattern), F.lit(name))
        out = out.when(any_of(text, V.TOLL_ARABIC_STEMS) & text.rlike(V.TOLL_ARABIC), F.lit("arabic"))
        for name, pattern in (("singular", V.TOLL_SINGULAR), ("zero", V.TOLL_ZERO), ("zero_unpublished", V.TOLL_UNPUBLISHED)):
            out = out.when(english & text.rlike(pattern), F.lit(name))
        return out.when(any_of(low, V.TOLL_WOUNDED_STEMS) & text.rlike(V.TOLL_WOUNDED), F.lit("wounded")).otherwise(F.lit("none"))

    return F.when(text.isNotNull(), once(F.lower(text), of))


def toll(text: Column) -> Column:
    """bucket (toll_bucket, found once) and count: the stated number of deaths, that of the counting phrase, 0 when it is said that
    there were none; else null."""
    spelled = F.create_map(*[x for word, n in V.NUMERALS.items() for x in (F.lit(word), F.lit(n))])

    def counted(bucket: Column) -> Column:
        out = F.lit(None).cast("int")
        for name, pattern in V.TOLL_COUNTS.items():
            found = F.lower(F.regexp_extract(text, pattern, 1))
            out = F.when(bucket == name, F.coalesce(F.replace(found, F.lit(",")).try_cast("int"), F.try_element_at(spelled, found))).otherwise(out)
        return F.struct(bucket.alias("bucket"), F.when(bucket == "zero", 0).when(bucket == "singular", 1).otherwise(out).alias("count"))

    return once(toll_bucket(text), counted)


def toll_count(text: Column) -> Column:
    """The stated number of deaths (see toll)."""
    return toll(text)["count"]


def flags(text: Column) -> Column:
    """Places whose flag stands among the first twenty characters, in the fixed order."""
    start = F.substring(text, 1, 20)
    return F.array_compact(F.array(*[F.when(F.contains(start, F.lit(flag)), F.lit(place)) for flag, place in V.FLAGS.items()]))


def fallback(text: Column, status: Column, keyword: Column | None = None) -> Column:
    """The record that stands for a reading when no model gave one: the place by keyword, else by flag. It measures no
    severity and no toll, so it has neither."""
    place = F.coalesce(*([keyword] if keyword is not None else []), F.try_element_at(flags(text), F.lit(1)), F.lit("Unknown"))
    return F.struct(F.lit("military").alias("event_type"), place.alias("location_name"), F.substring(text, 1, 200).alias("summary"), status.alias("extraction_status"))
