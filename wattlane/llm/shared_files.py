"""Files in the shared folder, opened from tasks."""

from __future__ import annotations

import pyarrow.fs as pafs

#: Schemes of Hadoop that have another name in ``pyarrow.fs``; besides ``file``, ``hdfs``, ``viewfs``, ``s3``, ``gs``, ``abfs(s)``.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is one of this machine."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri[len("file:"):] if uri.startswith("file:") else uri
    scheme, rest = uri.split("://", 1)
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme.lower(), scheme)}://{rest}")
