"""Normalisation through a compiled character map, with the source of every byte.

The map is the public sentencepiece format: four bytes of trie size, a double
array trie over UTF-8 bytes, then the replacement strings, each ended by a
zero byte. At each place of the text the longest prefix in the trie is
replaced; without one, a single character is copied.
"""

from __future__ import annotations

import re
import struct

import numpy as np

SPACE = "▁".encode()


class CharMap:
    """The map, and symbols that the model keeps as they are; the longest symbol at a place goes before the map."""

    def __init__(self, blob: bytes = b"", symbols: list[str] | None = None) -> None:
        longest_first = sorted((x.encode() for x in symbols or [] if x), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest prefix of ``data[at:]`` in the map, and where its replacement begins; length 0: none."""
        if not self.units:
            return 0, 0
        best, units = (0, 0), self.units
        node = 0
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                best = (i - at + 1, units[node] & 0x7FFFFFFF)
        return best

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the text at ``at`` becomes, and how many of its bytes that uses."""
        if self.symbols and (m := self.symbols.match(data, at)):
            return m[0], len(m[0])
        length, where = self.longest(data, at)
        if length:
            return self.strings[where : self.strings.index(b"\0", where)], length
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size


def normalise(text: str, chars: CharMap, dummy_prefix: bool, remove_extra: bool, escape: bool) -> tuple[bytes, np.ndarray]:
    """The normal form, and for each of its bytes (and its end) the source byte that it stems from.

    The empty text, and with ``remove_extra`` a text of spaces alone, is empty.
    Without a map each character is its own longest prefix, so all are copied
    at once; spaces alone change their length.
    """
    data = text.encode()
    if not chars.units and not chars.symbols and not remove_extra:
        return _copied(data, dummy_prefix, SPACE if escape else b" ")
    norm, source = _replaced(data, chars, dummy_prefix, remove_extra, escape)
    return norm, np.array(source, np.int32)


def _copied(data: bytes, dummy_prefix: bool, space: bytes) -> tuple[bytes, np.ndarray]:
    if not data:
        return b"", np.zeros(1, np.int32)
    size = np.where(np.frombuffer(data, np.uint8) == 32, len(space), 1)
    source = np.append(np.repeat(np.arange(len(data), dtype=np.int32), size), np.int32(len(data)))
    norm = data.replace(b" ", space)
    return (space + norm, np.concatenate([np.zeros(len(space), np.int32), source])) if dummy_prefix else (norm, source)


def _replaced(data: bytes, chars: CharMap, dummy_prefix: bool, remove_extra: bool, escape: bool) -> tuple[bytes, list[int]]:
    at, end = 0, len(data)
    if remove_extra:
        while at < end:
            piece, used = chars.prefix(data, at)
            if piece != b" ":
                break
            at += used
    out, source = bytearray(), []
    if at == end:
        return b"", [0]
    space = SPACE if escape else b" "
    if dummy_prefix:
        out += space
        source += [at] * len(space)
    spaced = remove_extra
    while at < end:
        piece, used = chars.prefix(data, at)
        if remove_extra and spaced:
            piece = piece.lstrip(b" ")
        if piece:
            for byte in piece:
                new = space if byte == 32 else bytes([byte])
                out += new
                source += [at] * len(new)
            spaced = remove_extra and piece.endswith(b" ")
        at += used
        if not remove_extra:
            spaced = False
    if remove_extra:
        while out.endswith(space):
            at = source[len(out) - len(space)]
            del out[len(out) - len(space) :], source[len(out) :]
    source.append(at)
    return bytes(out), source
