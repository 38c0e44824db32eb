"""The piece table of a SentencePiece file, read as a unigram model.

A segmentation's score is the sum of its pieces' scores; the best one wins, ties
at a place going to the longest last piece.  A character that is no piece costs
``unknown`` and is spelled in byte pieces.  A text gets one leading blank and its
blanks become U+2581; nothing else is normalised.

No piece holds a blank mark after another character, and none holds a line
break, so a text's segmentation is that of its pre-tokens side by side: a run of
blanks with the characters up to the next blank or line break, or a line break.
"""

from __future__ import annotations

import re
from collections.abc import Callable

BLANK = "▁"
VOCABULARY = "piece_bpe_32k.model"
SPLIT = re.compile(rf"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
#: Pre-tokens one worker keeps, none longer than LONG; the store starts anew when full.
KEPT, LONG = 200_000, 128


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.text[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10
        assert not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.id)
        by_id = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.bytes = [by_id.get(i, p.replace(BLANK, " ").encode() if p in self.id else b"") for i, p in enumerate(self.text)]

    def spell(self, character: str) -> list[int]:
        """Byte pieces of a character that is no piece."""
        return [self.byte_id.get(b, 0) for b in character.encode("utf-8", "surrogatepass")]


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, in order; joined they are its normalised form."""
    return SPLIT.findall(BLANK + text.replace(" ", BLANK)) if text else []


def kept_pieces(kept: dict, path: Callable[[str], str], name: str) -> Pieces:
    if ("pieces", name) not in kept:
        kept["pieces", name] = Pieces(path(name))
    return kept["pieces", name]
