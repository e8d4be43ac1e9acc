"""SentencePiece model files: the protobuf's fields, read without generated classes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


def fields(data: bytes):
    """``(number, value)`` of each field of a protobuf message: int, 4 or 8 raw bytes, or bytes."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at:at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, type
    kind: int
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool

    def spaces_lead(self) -> bool:
        """No piece has a space marker behind another character: text can be encoded word by word."""
        return all(SPACE not in p.lstrip(SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def parse_model(data: bytes) -> PieceModel:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    return PieceModel(
        tuple(pieces), trainer.get(3, UNIGRAM), trainer.get(40, 0), bool(trainer.get(35, 0)), normaliser.get(2, b""),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
