"""Scalar rules for payload sizes, chunks, delays, flags and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payload bytes a tile can carry per mode, and the most bytes a
# receiver keeps for itself when the rest travels with donors.
CAPACITY = {
    "BANNER": 5290,
    "CARPET": 8176,
    "CARPET_SHADE": 10192,
    "CARPET_BANNERS": 13466,
    "CARPET_SHADE_BANNERS": 15482,
    "CARPET_BANNERS_SHADE": 15482,
}
OWN_MAX = {**CAPACITY, "BANNER": 5208}
MODES = tuple(CAPACITY)

BYTES_PER_CHUNK = 84
BODY_CHARS = 48
CHUNK_HEADER_BYTES = 2
MAX_CHUNKS = 63
STACK = 64

# Channel sizes in bytes (the first channel loses its header).
CARPET_BYTES, CARPET_HEADER, SHADE_BYTES, OVERFLOW_BYTES = 8192, 16, 2016, 5290
# Channels in filling order per mode.
FILL_ORDER = {
    "BANNER": (),
    "CARPET": ("carpet",),
    "CARPET_SHADE": ("carpet", "shade"),
    "CARPET_BANNERS": ("carpet", "overflow"),
    "CARPET_SHADE_BANNERS": ("carpet", "shade", "overflow"),
    "CARPET_BANNERS_SHADE": ("carpet", "overflow", "shade"),
}
CHANNEL_BYTES = {"carpet": CARPET_BYTES - CARPET_HEADER, "shade": SHADE_BYTES, "overflow": OVERFLOW_BYTES}

# Bit of each flag in the flag word; srgb sits in a second word.
FLAG_BITS = {
    "all_shades": 0,
    "animated": 1,
    "mux": 2,
    "delta_frames": 3,
    "sparse_frames": 4,
    "av1": 5,
    "av1_lossy": 6,
    "av1_composite": 7,
}
FLAG2_BITS = {"srgb": 0}

DEFAULT_DELAY_MS, MIN_DELAY_MS, MAX_DELAY_MS = 100, 10, 10000
AUTHOR_BYTES, TITLE_BYTES = 16, 64


def capacity(mode: Column) -> Column:
    """Capacity in bytes of the mode named in a column (null if unknown)."""
    return F.create_map(*(F.lit(v) for kv in CAPACITY.items() for v in kv))[mode]


def chunk_count(n_bytes: Column) -> Column:
    return F.ceil((n_bytes + CHUNK_HEADER_BYTES) / BYTES_PER_CHUNK).cast("int")


def base64_chunk_count(n_bytes: Column, body_chars: int = BODY_CHARS) -> Column:
    """Chunks when the payload is written as padded base64 text."""
    chars = F.ceil(n_bytes / 3) * 4
    return F.ceil(chars / body_chars).cast("int")


def channel_split(n_bytes: Column, mode: str) -> dict[str, Column]:
    """Bytes per channel in the mode's filling order, and whether all of it fits."""
    zero = F.lit(0).cast("long")
    parts = {name: zero for name in CHANNEL_BYTES}
    used = 0
    for name in FILL_ORDER[mode]:
        room = CHANNEL_BYTES[name]
        parts[name] = F.greatest(F.least(n_bytes - used, F.lit(room)), F.lit(0)).cast("long")
        used += room
    overflow_chunks = F.when(parts["overflow"] > 0, chunk_count(parts["overflow"])).otherwise(F.lit(0))
    return {
        "carpet_bytes": parts["carpet"],
        "shade_bytes": parts["shade"],
        "overflow_bytes": parts["overflow"],
        "overflow_chunks": overflow_chunks,
        "chunks": chunk_count(n_bytes) if mode == "BANNER" else F.lit(0),
        "fits": n_bytes <= CAPACITY[mode],
    }


def flag_columns(flags: Column, flags2: Column) -> dict[str, Column]:
    """Boolean columns for every known flag bit."""
    out = {name: F.getbit(flags, F.lit(bit)) == 1 for name, bit in FLAG_BITS.items()}
    out.update({name: F.getbit(flags2, F.lit(bit)) == 1 for name, bit in FLAG2_BITS.items()})
    return out


def crc32_matches(data: Column, stored: Column) -> Column:
    return F.crc32(data) == stored


def truncate_utf8(text: Column, max_bytes: int) -> Column:
    """The first ``max_bytes`` bytes of the UTF-8 form (may end inside a character)."""
    return F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, max_bytes)


def clamp_delay(ms: Column) -> Column:
    present = F.coalesce(ms, F.lit(DEFAULT_DELAY_MS))
    return F.greatest(F.lit(MIN_DELAY_MS), F.least(F.lit(MAX_DELAY_MS), present))


def filename_stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def slug(name: Column) -> Column:
    bare = F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def save_suffix(name: Column) -> Column:
    """Digits of a ``stem_NNN.json`` name, or the empty string."""
    return F.regexp_extract(name, r"^.+_([0-9]+)\.json$", 1)


def save_stem(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.+)_[0-9]+\.json$", 1)


def valid_chunk_kind(name: Column) -> Column:
    """``LC``, ``LS`` or ``MG`` headers, ``chunk`` for a two-place hex index (a sign may lead), else null."""
    n = F.length(name)
    return (
        F.when((n >= 6) & name.startswith("LC"), F.lit("LC"))
        .when((n >= 10) & name.startswith("LS"), F.lit("LS"))
        .when((n >= 24) & name.startswith("MG"), F.lit("MG"))
        .when(name.rlike(r"^[0-9a-fA-F+-][0-9a-fA-F]"), F.lit("chunk"))
    )
