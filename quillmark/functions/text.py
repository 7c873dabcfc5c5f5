"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.vocabulary import LOOPBACK_HOSTS, SENSITIVITY, TASKS


def rank(level: Column) -> Column:
    """1 (most open) to 7 (most private); null for null and for unknown levels."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SENSITIVITY)), level), F.lit(0)).cast("int")


def level_of(position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SENSITIVITY)), position)


def raise_only(current: Column, proposed: Column) -> Column:
    """What an automated proposal may lead to: the stricter of the two; an unknown proposal changes nothing."""
    return level_of(F.greatest(rank(current), F.coalesce(rank(proposed), rank(current))))


def resolve_task(name: Column) -> Column:
    """The task behind a friendly name; other names pass through."""
    aliases = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, name), name)


def is_loopback(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(*LOOPBACK_HOSTS), F.lit(False))


def encode_query(value: Column) -> Column:
    """Percent-encoding of all but the unreserved characters of RFC 3986."""
    out = F.url_encode(value)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def base_url(port: Column) -> Column:
    return F.concat(F.lit("http://127.0.0.1:"), port.cast("string"))


def mcp_url(port: Column) -> Column:
    return F.concat(base_url(port), F.lit("/mcp"))


def viewer_query(port: Column, token: Column) -> Column:
    return F.concat(F.lit("api="), encode_query(base_url(port)), F.lit("&token="), encode_query(F.coalesce(token, F.lit(""))))


def viewer_url(page: str, port: Column, token: Column) -> Column:
    return F.concat(F.lit(page), F.lit("?"), viewer_query(port, token))


def encode_component(value: Column) -> Column:
    """Percent-encoding as of a browser's component encoder, which also leaves ``!'()*`` alone."""
    out = encode_query(value)
    for a, b in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def bearer(token: Column) -> Column:
    """The authorization header; null without a token."""
    clean = F.nullif(F.trim(token), F.lit(""))
    return F.when(clean.isNotNull(), F.concat(F.lit("Bearer "), clean))


def client_settings(server: str, port: Column, token: Column, transport: str | None = None) -> Column:
    """A client's JSON block for the local endpoint; ``transport`` where the client wants its kind named."""
    kind = [F.lit(transport).alias("type")] if transport else []
    entry = F.struct(*kind, mcp_url(port).alias("url"), F.struct(bearer(token).alias("Authorization")).alias("headers"))
    return F.to_json(F.struct(F.struct(entry.alias(server)).alias("mcpServers")), {"pretty": "true"})


def after_hash(value: Column) -> Column:
    """What follows the first '#'; '' without one."""
    at = F.instr(value, "#")
    return F.when(at == 0, "").otherwise(F.substring(value, at + 1, F.length(value)))


def is_naive_time(raw: Column) -> Column:
    """Whether a raw timestamp has a clock time but no zone."""
    clock = raw.rlike(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    return F.coalesce(clock & ~raw.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\s*$"), F.lit(False))
