"""Values: JSON documents, timestamps, durations, variable-length numbers, seeded payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an event keeps its topic: a field of its metadata. Logs from elsewhere may use another name for it, a parameter below.
METADATA, ENTITY = "@metadata", "Entity-Name"


def field(document: Column, name: str, kind: str = "string") -> Column:
    """A field of a JSON text; null if it is missing or isn't of that kind."""
    return F.get_json_object(document, f"$['{name}']").try_cast(kind)


def stamped(document: Column, topic: Column | str, entity: str = ENTITY) -> Column:
    """The document with its topic in its metadata, which is made if there is none. Field order may change; a text that is no object is null."""
    topic = F.lit(topic) if isinstance(topic, str) else topic
    fields = "map<string,variant>"
    whole = F.from_json(document, fields)
    none = F.from_json(F.lit("{}"), fields)
    inner = F.coalesce(F.try_variant_get(F.try_element_at(whole, F.lit(METADATA)), "$", fields), none)
    stamp = F.create_map(F.lit(entity), F.to_variant_object(F.create_map(F.lit("v"), topic)))
    stamp = F.transform_values(stamp, lambda _, v: F.variant_get(v, "$.v", "variant"))
    entry = F.to_json(F.map_concat(F.map_filter(inner, lambda k, _: k != entity), stamp))
    rest = F.regexp_replace(F.trim(document), r"\s*\}$", "")
    simple = F.concat(rest, F.when(rest.endswith("{"), "").otherwise(","), F.lit(f'"{METADATA}":'), entry, F.lit("}"))
    others = F.map_filter(whole, lambda k, _: k != METADATA)
    replaced = F.to_json(F.map_concat(others, F.create_map(F.lit(METADATA), F.parse_json(entry))))
    return F.when(whole.isNull(), F.lit(None)).when(F.map_contains_key(whole, METADATA), replaced).otherwise(simple)


def timestamp(text: Column) -> Column:
    """An ISO-8601 text as a timestamp; null if it is none."""
    return F.try_to_timestamp(text)


def duration_seconds(text: Column) -> Column:
    """Seconds of [-][d.]hh:mm:ss[.fffffff]; null if it is something else."""
    pattern = r"^(-)?(?:(\d+)\.)?(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)$"

    def part(k: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("double"), F.lit(0.0))

    seconds = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    return F.when(text.rlike(pattern), F.when(F.regexp_extract(text, pattern, 1) == "-", -seconds).otherwise(seconds))


def varint(number: Column) -> Column:
    """A number of 0 or more in groups of 7 bits, the lowest first, the high bit on all but the last (LEB128), as a binary. Null for null and below 0."""
    n = number.cast("bigint")
    last = F.floor((F.greatest(F.length(F.bin(n)), F.lit(1)) - 1) / 7).cast("int")

    def byte(i: Column) -> Column:
        group = F.call_function("shiftright", n, 7 * i).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(group + F.when(i < last, F.lit(128)).otherwise(F.lit(0))), 2, "0")

    return F.when(n >= 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), byte), "")))


def unvarint(value: Column) -> Column:
    """The number that `varint` has written."""

    def add(total: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(value, i + 1, F.lit(1))), 16, 10).cast("bigint")
        return total + F.call_function("shiftleft", byte.bitwiseAND(F.lit(127)), 7 * i)

    return F.aggregate(F.sequence(F.lit(0), F.octet_length(value) - 1), F.lit(0).cast("bigint"), add)


def payload(seed: Column, size: int, share: float = 0.5) -> Column:
    """`size` printable characters that follow from the seed: about `share` of them are random, the rest repeat those, as for values that compress by so much."""
    fresh = max(1, min(size, round(size * share)))
    blocks = F.transform(F.sequence(F.lit(0), F.lit((fresh - 1) // 64)), lambda i: F.sha2(F.concat_ws("/", seed.cast("string"), i.cast("string")), 256))
    piece = F.substring(F.array_join(blocks, ""), 1, fresh)
    return F.substring(F.repeat(piece, -(-size // fresh)), 1, size)
