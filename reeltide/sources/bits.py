"""Reading big-endian structures; a read past the end says which bytes are missing."""

from __future__ import annotations


class Missing(Exception):
    """Input ended inside a structure: `offset` and `length` of the bytes that were asked for."""

    def __init__(self, offset: int, length: int):
        super().__init__(f"{length} bytes at {offset} are missing")
        self.offset, self.length = offset, length


class Cursor:
    """A place in a byte string."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else min(end, len(data))

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Missing(self.at, n)
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def text(self, n: int) -> str:
        return self.take(n).decode("latin-1")

    def sub(self, n: int) -> Cursor:
        """The next n bytes as a cursor of their own."""
        if self.at + n > self.end:
            raise Missing(self.at, n)
        out = Cursor(self.data, self.at, self.at + n)
        self.at += n
        return out
