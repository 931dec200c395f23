"""Encoding by public tokenizer files, and cutting long texts where no token can cross.

A ``.json`` file is read by ``tokenizers``, a ``.model`` file by ``sentencepiece``. A byte-level
BPE file that splits by the usual pattern may have the same vocabulary beside it as ranks
(``.tiktoken``): texts of Latin-1 characters, whose classes are the same in every Unicode
version, then go through ``tiktoken``, which gives the same ids in a third of the time.

Cuts. Between a character that is no white space and white space, no token of these files goes
on: the split patterns keep white space only in front of a word, and a lookahead sees the
same on both sides; no piece of a sentence model has the space sign behind another
character (looked up when it is loaded), so a single space between other characters
begins a piece there. Files of another kind are never cut.
"""
from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

_BEFORE_SPACE = {"json": re.compile(r"(?<=\S)(?=[ \t\n\r])"), "model": re.compile(r"(?<=[^\s▁])(?= [^\s▁])")}
SPACE_SIGN = "▁"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints,
    else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(others)}


def text_of(value: bytes | None) -> str:
    """A text column's value; bytes that are not UTF-8 become U+FFFD."""
    return (value or b"").decode("utf-8", "replace")


class Tokens:
    """Ids of texts without begin, end or added special tokens, truncation or padding.

    ``plain_specials``: strings of special tokens inside texts are ordinary text (for a ``.model``
    file they always are).
    """

    def __init__(self, path: str, plain_specials: bool = False):
        self.kind = "model" if path.endswith(".model") else "json"
        self.fast, self.specials = None, []
        if self.kind == "model":
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.model.get_piece_size()
            pieces = (self.model.id_to_piece(i) for i in range(self.size))
            # what follows a cut loses its space to the one that the model puts in front of a text
            self.cuts = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces) and \
                self.model.encode("a  b c") == self.model.encode("a") + self.model.encode(" b") + self.model.encode("c")
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = plain_specials
        added = self.model.get_added_tokens_decoder()
        self.size = max([*self.model.get_vocab().values(), *added]) + 1
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split, norm = rules["pre_tokenizer"] or {}, rules["normalizer"]
        byte_level = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and norm is None
        words_only = split.get("type") == "Sequence" and split["pretokenizers"][0].get("behavior") == "Removed" and \
            [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.cuts = (byte_level or words_only) and not any(
            t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in added.values())
        if not plain_specials:
            self.specials = [t.content for t in added.values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        if byte_level and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            byte_of = byte_alphabet()
            same = {bytes(byte_of[c] for c in t): i for t, i in rules["model"]["vocab"].items() if i not in added}
            if same == table:
                self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _ranked(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self.specials)

    def __call__(self, texts: list[str]) -> list:
        """Ids of every text, one batch for the whole list."""
        if self.kind == "model":
            return self.model.encode(texts, num_threads=1)
        out: list = [None] * len(texts)
        if self.fast is not None:
            for k, t in enumerate(texts):
                if self._ranked(t):
                    out[k] = self.fast.encode_ordinary(t)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.model.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self(texts)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id of a byte-level ``.json`` file, or of a sentence model with the
        space sign as a space and <0xHH> as that byte."""
        if self.kind == "model":
            names = [self.model.id_to_piece(i) for i in range(self.size)]
            return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE_SIGN, " ").encode()
                    for p in names]
        byte_of, out = byte_alphabet(), [b""] * self.size
        for token, i in self.model.get_vocab().items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for i, t in self.model.get_added_tokens_decoder().items():
            out[i] = t.content.encode()
        return out


def parts(text: str, most: int, tokens: Tokens) -> Iterator[str]:
    """``text`` cut at the first safe place after every ``most`` characters, whole if there is none.

    Joined with nothing (``.json``) or with one space (``.model``) between them, they are the text again.
    """
    at = 0
    while tokens.cuts and len(text) - at > most:
        m = _BEFORE_SPACE[tokens.kind].search(text, at + most)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start() + (tokens.kind == "model")
    yield text[at:]
