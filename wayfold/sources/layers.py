"""Image layer tars as rows, through a small table function around tarfile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marker names of a layer (fixed values).
WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"
ENTRY = "path string, marker string, kind string, mode string, owner string, size bigint, sha256 string, mtime double"


def member_path(name: str) -> str | None:
    """Absolute path of a tar member; None for the root itself; a member above the root is an error."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"{name!r} lies outside of the layer")
    return "/" + "/".join(parts) if parts else None


class LayerEntries:
    """eval(content): one row for each path of a layer, the last member of a path; hard links take their target's content."""

    def eval(self, content: bytes):
        import gzip
        import hashlib
        import io
        import tarfile

        data = bytes(content)
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            data = zstandard.ZstdDecompressor().stream_reader(data).read()
        rows: dict[tuple[str, str | None], tuple] = {}
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
            for m in tar:
                path = member_path(m.name)
                if path is None:
                    continue
                parent, _, base = path.rpartition("/")
                if base == OPAQUE:
                    rows[parent or "/", "opaque"] = (parent or "/", "opaque", None, None, None, None, None, None)
                elif base.startswith(WHITEOUT):
                    gone = f"{parent}/{base[len(WHITEOUT):]}"
                    rows[gone, "whiteout"] = (gone, "whiteout", None, None, None, None, None, None)
                else:
                    kind = "dir" if m.isdir() else "symlink" if m.issym() else "file" if m.isfile() or m.islnk() else "other"
                    size = digest = None
                    if m.islnk():
                        target = rows.get((member_path(m.linkname), None))
                        size, digest = (target[5], target[6]) if target else (None, None)
                    elif m.issym():
                        text = m.linkname.encode("utf-8", "surrogateescape")
                        size, digest = len(text), hashlib.sha256(text).hexdigest()
                    elif m.isfile():
                        text = tar.extractfile(m).read()
                        size, digest = len(text), hashlib.sha256(text).hexdigest()
                    rows[path, None] = (path, None, kind, f"{m.mode & 0o7777:04o}", f"{m.uid}:{m.gid}", size, digest, float(m.mtime))
        yield from rows.values()


def entries(layers: DataFrame) -> DataFrame:
    """(trial_id, seq, path, marker, kind, mode, owner, size, sha256, mtime) from (trial_id, seq, content)."""
    read = F.udtf(LayerEntries, returnType=ENTRY)
    layers.sparkSession.udtf.register("wayfold_layer_entries", read)
    layers.createOrReplaceTempView("wayfold_layers")
    return layers.sparkSession.sql("select l.trial_id, l.seq, e.* from wayfold_layers l, lateral wayfold_layer_entries(l.content) e")


def layer_files(spark: SparkSession, glob: str) -> DataFrame:
    """(trial_id, seq, content) of files .../<trial_id>/<seq>.tar[.gz|.zst]."""
    raw = spark.read.format("binaryFile").load(glob)
    return raw.select(F.regexp_extract("path", r"([^/]+)/\d+\.tar[^/]*\z", 1).alias("trial_id"), F.regexp_extract("path", r"/(\d+)\.tar[^/]*\z", 1).cast("int").alias("seq"), "content")
