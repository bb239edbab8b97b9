"""Column layouts shared by sources, operators and state tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType, TimestampType

_TYPES = {
    "string": StringType(), "long": LongType(), "int": IntegerType(), "boolean": BooleanType(),
    "timestamp": TimestampType(), "array<string>": ArrayType(StringType()),
}


def columns(text: str) -> StructType:
    """Schema from ``name type, ...``; unlike ``fromDDL`` it needs no running session."""
    schema = StructType()
    for column in text.split(","):
        name, kind = column.split()
        schema.add(name, _TYPES[kind])
    return schema


MESSAGES = columns(
    "mirror string, folder string, epoch long, uid long, message_id string, sender string, "
    "subject string, internal_date timestamp, size long, flags array<string>"
)
BODIES = columns("mirror string, folder string, epoch long, uid long, raw string")
FOLDERS = columns("mirror string, folder string, attrs array<string>, list_pos long")
FOLDER_STATUS = columns("mirror string, folder string, epoch long, uid_next long, n long")

# State tables. Every one also carries the partition columns ``batch_id`` and ``attempt``.
STATE_TABLES = {
    name: columns(ddl)
    for name, ddl in {
        "ledger": "mirror string, key string, is_synth boolean, uid long, copied_at long, source string",
        "member_log": "mirror string, folder string, key string, is_synth boolean, uid long, op string",
        "folder_state": "mirror string, folder string, epoch long, last_uid long",
        "folder_bands": "mirror string, folder string, epoch long, uid_band long, n long, digest string",
        "mirror_state": "mirror string, epoch long, last_uid long, fingerprint string, heartbeat long",
        "dest_messages": (
            "mirror string, copy_id string, folder string, key string, is_synth boolean, uid long, "
            "sender string, subject string, internal_date timestamp, size long, flags array<string>, "
            "tags array<string>, raw string"
        ),
        "placement_log": "mirror string, copy_id string, key string, from_folder string, folder string, "
                         "seq long, reason string",
        "tag_log": "mirror string, copy_id string, key string, tag string, op string, seq long, reason string",
        "pending_ops": "mirror string, seq long, kind string, key string, folder string, op string",
        "applied_ops": "mirror string, op_batch long, seq long, status string",
        "missing_bodies": "mirror string, folder string, epoch long, uid long, key string",
        "rejected_tags": "mirror string, key string, tag string",
        "run_log": (
            "mirror string, epoch_changed boolean, candidates long, copied long, skipped_dup long, "
            "moved_to_archive long, moved_to_inbox long, moved_to_sent long, tags_set long, "
            "tags_updated long, ops_applied long, missing_bodies long, rejected_tags long"
        ),
        "phase_log": "phase string, seconds long, n_rows long",
    }.items()
}
