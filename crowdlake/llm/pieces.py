"""Reading a piece vocabulary with byte fallback, and joining symbols by its scores.

Both token operators share this: what the vocabulary's strings are, and which pieces a short string is
joined into. The vocabulary file is a parameter; it is read where it is needed, by its path.
"""

from __future__ import annotations

import functools
import re

from sentencepiece import sentencepiece_model_pb2

#: What stands for a space in pieces.
SPACE = "▁"
_NORMAL, _BYTE = 1, 6


class Pieces:
    """Vocabulary of a piece model of BPE type with byte fallback and identity normalization."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        plain = norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if spec.model_type != 2 or not spec.byte_fallback or not plain or not kinds <= {1, 2, 3, 6}:
            raise ValueError(f"{path}: only BPE pieces with byte fallback and plain normalization are supported")
        self.text = [p.piece for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id))
        self.chars = set().union(*self.id)
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError(f"{path}: a piece continues over a space")

    def merged(self, text: str) -> list[str]:
        """The pieces that ``text`` is joined into: always the pair of highest score, the leftmost of equals."""
        get, none = self.score.get, -float("inf")
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            top = max(scores)
            if top == none:
                break
            i = scores.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def ids_of(self, part: str) -> list[int]:
        """Ids of one piece, or of its bytes if the vocabulary lacks it."""
        i = self.id.get(part)
        return [i] if i is not None else [self.byte[b] for b in part.encode("utf-8", "replace")]

    def decoded(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one for each."""
        out, pending = [], bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(_text(bytes(pending)))
                pending.clear()
            out.append(self.text[i])
        if pending:
            out.append(_text(bytes(pending)))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            i += n
        return "".join(out)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


#: Segments of escaped text that no piece crosses: spaces with what follows them, or a line feed.
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def segments(text: str) -> list[str]:
    """The segments of a text with its space in front; none of the empty text."""
    return SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []
