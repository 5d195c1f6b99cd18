"""Files that tasks write themselves, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(path: str, parts: list[bytes]) -> None:
    """Writes a file so that it is seen whole or not at all, also when an attempt of the task is lost.

    Two attempts write the same bytes under names of their own; the last one to end moves its file
    to ``path``. Local, HDFS, S3 and GCS addresses work.
    """
    system, name = fs.FileSystem.from_uri(path)
    folder, _, last = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    unfinished = f"{folder}/_{last}.{uuid.uuid4().hex}"
    with system.open_output_stream(unfinished) as out:
        for part in parts:
            out.write(part)
    system.move(unfinished, name)
