"""Paid answers, kept as they arrive and found again by what was asked.

An entry is one small file in a folder that all executors reach, named by the digest of model,
parameters and prompt. A task that is repeated, or a run that is started anew, finds what was
answered before and asks only for the rest. Entries are written under another name first, so one
that can be read is whole. Any folder that Arrow's file systems know will do: a path, or the
address of an object store. Two tasks that ask the same at the same moment both pay.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs


class Ledger:
    def __init__(self, folder: str):
        if "://" in folder or folder.startswith("file:"):
            self.files, self.root = fs.FileSystem.from_uri(folder)
        else:
            self.files, self.root = fs.LocalFileSystem(), folder

    @staticmethod
    def key(prompt: str, model: str, n: int, temperature: float, **more: object) -> str:
        return hashlib.sha256(json.dumps([model, n, temperature, sorted(more.items()), prompt]).encode()).hexdigest()

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> tuple[list[str], int] | None:
        """Answers and the tokens that were paid for them."""
        path = self._path(key)
        if self.files.get_file_info(path).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(path) as stream:
            held = json.loads(stream.read())
        return held["texts"], held["tokens"]

    def put(self, key: str, texts: list[str], tokens: int) -> None:
        path = self._path(key)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(own) as stream:
            stream.write(json.dumps({"texts": texts, "tokens": tokens}).encode())
        self.files.move(own, path)
