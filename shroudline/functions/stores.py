"""Files of any store that driver and tasks share, whole or not at all."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def create(fs: pafs.FileSystem, path: str, content: bytes) -> bool:
    """Create a file; False if another one is there. What is seen under the name is whole.

    On a local file system a link is refused if the name is taken; elsewhere the name is looked for before the file is moved there.
    """
    beside = f"{path}.{uuid.uuid4().hex}"
    if isinstance(fs, pafs.LocalFileSystem):
        with open(beside, "xb") as out:
            out.write(content)
        try:
            os.link(beside, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
        return True
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        return False
    with fs.open_output_stream(beside) as out:
        out.write(content)
    fs.move(beside, path)
    with fs.open_input_stream(path) as got:
        return got.read() == content


@dataclass(frozen=True)
class AnswerStore:
    """Answers by key in a folder that tasks share. The first answer of a key stays.

    Tasks put answers as they come, so that the attempt of a lost task, or another run, finds them.
    An answer is a file, as a call costs far more than one.
    """

    path: str

    def _place(self, key: str) -> tuple[pafs.FileSystem, str]:
        fs, root = file_system(self.path.rstrip("/"))
        return fs, f"{root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        fs, place = self._place(key)
        try:
            with fs.open_input_stream(place) as got:
                return json.loads(got.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, value: dict) -> None:
        fs, place = self._place(key)
        fs.create_dir(posixpath.dirname(place), recursive=True)
        create(fs, place, json.dumps(value).encode())

    def drop(self, key: str) -> None:
        """Forget an answer, if it is there."""
        fs, place = self._place(key)
        if fs.get_file_info(place).type == pafs.FileType.File:
            fs.delete_file(place)
