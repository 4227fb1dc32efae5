"""Identities made of hashes: canonical JSON, seeds, run, shard and score shard ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_VERSION = 1


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, no spaces, raw UTF-8 and nulls kept; control characters in lower-case escapes."""
    made = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    for code in (*range(0x0A, 0x10), *range(0x1A, 0x20)):
        made = F.replace(made, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}")) if f"{code:04X}" != f"{code:04x}" else made
    return made


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def seed(base_seed: Column, dataset: Column, sample_id: Column, strategy: Column, rollout_index: Column, version: int = SEED_VERSION) -> Column:
    """An unsigned 64-bit seed: the first eight bytes of the SHA-256 of a rollout's identity."""
    text = canonical_json(
        base_seed=base_seed, dataset=dataset, rollout_index=rollout_index, sample_id=sample_id, seed_derivation_version=F.lit(version),
        strategy=strategy,
    )
    return F.conv(F.substring(sha256_hex(text), 1, 16), 16, 10).cast("decimal(20,0)")


def uuid5_hex(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The 32 hexadecimal digits of a version 5 UUID."""
    digest = F.sha1(F.concat(F.lit(namespace.bytes), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def run_id(group_id: Column, dataset: Column, split: Column, filter_id: Column, strategy: Column, prefix: str = "tessera") -> Column:
    """``run-`` and 16 digits; ``prefix`` is the first part of the name that is hashed."""
    return F.concat(F.lit("run-"), F.substring(uuid5_hex(F.concat_ws(":", F.lit(prefix), group_id, dataset, split, filter_id, strategy)), 1, 16))


def group_id(created: Column, config_hash: Column) -> Column:
    return F.concat(F.lit("exp-"), F.date_format(created, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(config_hash, 1, 8))


def shard_id(sample_id: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("sample-"), F.substring(sha256_hex(sample_id), 1, 16), F.format_string("-r%04d-%04d", first, last))


def score_shard_id(core: Column, payload: Column) -> Column:
    """A core shard's id and 16 digits of the payload (canonical JSON of scorer hashes and rollouts)."""
    return F.concat(core, F.lit("-"), F.substring(sha256_hex(payload), 1, 16))


def sample_id(first: Column, second: Column, answer: Column, image_sha256: Column, question: Column) -> Column:
    """The first id that isn't blank; else a hash of the content."""
    from tessera.functions.text import blank_to_null

    made = F.concat(F.lit("sha256-"), sha256_hex(canonical_json(answer=answer, image_sha256=image_sha256, question=question)))
    return F.coalesce(blank_to_null(first.cast("string")), blank_to_null(second.cast("string")), made)
