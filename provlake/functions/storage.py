"""Files by path or URI, on whatever file system pyarrow knows: local, HDFS, S3, GCS."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyarrow.fs import FileSystem, LocalFileSystem


def absolute(root: str) -> str:
    """`root` as any process may name it: a URI as it is, a path from its top."""
    return root if urlsplit(root).scheme else os.path.abspath(root)


def opened(root: str) -> tuple[FileSystem, str]:
    """The file system of `root`, and `root` as a path there."""
    if urlsplit(root).scheme:
        fs, base = FileSystem.from_uri(root)
    else:
        fs, base = LocalFileSystem(), os.path.abspath(root)
    return fs, base.rstrip("/")
