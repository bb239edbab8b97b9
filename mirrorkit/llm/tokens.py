"""Token ids of whole texts by a public tokenizer file, with a memory of words met before.

Subword merging takes nearly all of the time, and words repeat. A tokenizer that first cuts at white
space gives a text the ids of its words one after another, so a word's ids can be kept. Whether a file
does so is read from the file; with any other file whole texts are encoded.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

TOKENIZER_FILE = "word_bpe_49k.json"

# The rules under which words are independent. White space is dropped and joins nothing, a
# run of letters is one piece, and the last id of each piece carries the word end.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPECIAL = "<|"
# Words remembered in a generation.
ROOM = 250_000

# Letters that stay single letters in lower case, and what may follow them: trailing ASCII punctuation is a
# piece of its own, unless an apostrophe may start a contraction or a special token's bracket is about.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*)")
JOINED = 4096


def public_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _by_words(rules: dict) -> bool:
    """Whether a text's ids are those of its words, by the rules of a tokenizer file."""
    return (
        rules["normalizer"] == WORD_NORMALIZER and rules["pre_tokenizer"] == WORD_PIECES
        and rules["post_processor"] is None and rules["model"]["type"] == "BPE"
        and bool(rules["model"]["end_of_word_suffix"]) and all(SPECIAL in token["content"] for token in rules["added_tokens"])
    )


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, those of ``encode(text, add_special_tokens=False)``.

    ``room`` bounds the words remembered: when a generation is full, the one before it is forgotten.
    """

    def __init__(self, path: str, room: int = ROOM) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = _by_words(rules)
        if self.by_words:
            end = rules["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(end)]] = True
        self.room = room
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            found = self.tokenizer.encode_batch_fast(texts[at:at + 512], add_special_tokens=False)
            out += [np.asarray(enc.ids, dtype="<u4").tobytes() for enc in found]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: encoded as one text and cut at word ends, which saves most of the time."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            part = words[at:at + JOINED]
            data = self._encoded([" ".join(part)])[0]
            stops = (4 * np.flatnonzero(self.ends[np.frombuffer(data, dtype="<u4")]) + 4).tolist()
            if len(stops) == len(part) and stops[-1] == len(data):
                out += [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            else:
                out += self._encoded(part)
        return out

    def _recall(self, words: set[str]) -> set[str]:
        """The words not remembered; those of the generation before are taken over."""
        todo = words.difference(self.new)
        again = todo & self.old.keys()
        self.new.update((word, self.old[word]) for word in again)
        return todo - again

    def _learn(self, words: set[str]) -> None:
        whole: set[str] = set()
        cut: list[tuple[str, str, str]] = []
        for word in self._recall(words):
            found = _PLAIN.fullmatch(word)
            if found is None:
                whole.add(word)
            else:
                cut.append((word, *found.groups()))
        letters = list(self._recall({stem for _, stem, _ in cut}))
        others = list(self._recall(whole | {tail for _, _, tail in cut}))
        self.new.update(zip(letters, self._letters(letters), strict=True))
        self.new.update(zip(others, self._encoded(others), strict=True))
        self.new.update((word, self.new[stem] + self.new[tail]) for word, stem, tail in cut if tail)

    def batch(self, texts: list[str]) -> list[bytes]:
        """One value per text; an empty text has no ids."""
        if not self.by_words:
            return self._encoded(texts)
        if len(self.new) > self.room:
            self.old, self.new = self.new, {"": b""}
        split = []
        for text in texts:
            if text.isascii() and SPECIAL not in text:
                text = text.lower()
            split.append(text.replace("\n", " ").split(" "))
        self._learn(set().union(*split))
        ids_of = self.new.__getitem__
        return [b"".join(map(ids_of, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str, room: int = ROOM) -> WordEncoder:
    """The encoder of this Python worker; it lives on from task to task."""
    return WordEncoder(path, room)


def id_batches(batch, path: str, end_id: int, width: int = 128, room: int = ROOM):
    """Yield (doc ids, list of id bytes with the end id) for slices of an Arrow batch; null texts are empty."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    own = encoder(path, room)
    for at in range(0, batch.num_rows, width):
        part = batch.slice(at, width)
        texts = [text or "" for text in part.column("text").to_pylist()]
        yield part.column("doc_id").to_pylist(), [ids + end for ids in own.batch(texts)]
