"""Public surfaces of changed entry points, compared between two revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_entry_point
from ..operators.relations import export_changes
from ..sources import typescript_modules
from ..sources.texts import parse
from .cut import cut

# Bytes of a source that is read at a revision, and what limitations say.
MAX_BYTES = 4_000_000
SCOPE = "Public-surface comparison is limited to changed conventional index modules."
BROKEN = "Public-surface comparison issue: %s (%s)."
UNREAD = "Public-surface source could not be read at an analyzed revision (%s)."
_SEPARATOR = "\x1f"


def public_surface(files: DataFrame, snapshots: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Export changes (change_id, path, name, change) and limitations (change_id, limitation).

    ``files``: change_id, path, status and, where known, previous_path and
    binary. ``snapshots``: change_id, side (base or head), path, text. A file
    that can't be read or parsed on a side where it must be has no changes.
    """
    told = {"previous_path": F.lit(None).cast("string"), "binary": F.lit(False)}
    files = files.withColumns({c: v for c, v in told.items() if c not in files.columns})
    entries = cut(files.where(~F.col("binary") & is_entry_point("path")).select("change_id", "path", "previous_path", "status"))
    base = entries.where("status <> 'added'").select("change_id", "path", F.lit("base").alias("side"), F.coalesce("previous_path", "path").alias("at"))
    head = entries.where("status <> 'deleted'").select("change_id", "path", F.lit("head").alias("side"), F.col("path").alias("at"))
    texts = snapshots.where(F.octet_length("text") <= max_bytes).select("change_id", "side", F.col("path").alias("at"), "text")
    read = base.unionByName(head).join(texts, ["change_id", "side", "at"], "left")
    key = F.concat_ws(_SEPARATOR, F.col("change_id").cast("string"), "side", "path")
    rows, issues = parse(read.where("text IS NOT NULL").select(key.alias("k"), "path", "text"), "k", typescript_modules.exports, typescript_modules.EXPORTS, ("path", "text"))
    part = lambda n: F.split("key", _SEPARATOR)[n]
    change_id = part(0).cast(files.schema["change_id"].dataType).alias("change_id")
    unread = read.where("text IS NULL").select("change_id", "path").distinct()
    broken = issues.select(change_id, part(2).alias("path"), "issue").distinct()
    lost = unread.unionByName(broken.drop("issue")).distinct()
    found = rows.select(change_id, part(1).alias("side"), "path", "name", "signature").join(lost, ["change_id", "path"], "left_anti")
    notes = unread.select("change_id", F.format_string(UNREAD, "path").alias("limitation"))
    notes = notes.unionByName(broken.select("change_id", F.format_string(BROKEN, "issue", "path").alias("limitation")))
    return export_changes(found), notes.unionByName(files.select("change_id").distinct().select("change_id", F.lit(SCOPE).alias("limitation")))
