"""Archive files in the shared folder, written and read by tasks through the file system their URI names."""

from __future__ import annotations

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = locate(uri)
    system.create_dir(path, recursive=True)


class RollingFile:
    """Files of about ``roll`` bytes; ``name`` gives the name of the next. A file counts only once its writer reports it."""

    def __init__(self, folder: str, name, roll: int):
        self.system, self.folder = locate(folder)
        self.name, self.roll = name, roll
        self.stream, self.path, self.at = None, "", 0
        self.done: list[tuple[str, int]] = []

    def place(self) -> tuple[str, int]:
        """The file that the next data go to, opened if there is none, and their offset in it."""
        if self.stream is None:
            self.path, self.at = self.name(), 0
            self.stream = self.system.open_output_stream(f"{self.folder}/{self.path}", compression=None)
            if head := self.header(self.path):
                self.stream.write(head)
                self.at = len(head)
        return self.path, self.at

    def write(self, data: bytes) -> tuple[str, int]:
        """Append ``data``; the file's name and the offset of the data in it."""
        path, start = self.place()
        self.stream.write(data)
        self.at += len(data)
        if self.at >= self.roll:
            self.close()
        return path, start

    def header(self, path: str) -> bytes:
        return b""

    def trailer(self) -> bytes:
        return b""

    def close(self) -> list[tuple[str, int]]:
        if self.stream is not None:
            tail = self.trailer()
            self.stream.write(tail)
            self.stream.close()
            self.done.append((self.path, self.at + len(tail)))
            self.stream = None
        return self.done
