"""Binary files on any file system that pyarrow reaches, named by URI.

Writers run in tasks.  Each attempt writes under a name of its own and returns that name;
the table of names, committed by Spark, tells which files count, so files of lost or
repeated attempts are never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_fs(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def unique_name(folder: str, stem: str, suffix: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def open_random(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)


def open_stream(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_stream(path)
