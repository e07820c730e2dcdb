"""Words of the packing operator: looked up without their signs, remembered in a bounded cache."""

import pyarrow as pa
from tokenizers import Tokenizer

from quillgraph.llm import packing


def _ids(texts, kind=pa.string()):
    return [list(memoryview(raw).cast("H")) for raw in packing.token_bytes(pa.array(texts, kind), packing.default_vocabulary())]


def _whole(texts):
    tok = Tokenizer.from_file(packing.default_vocabulary())
    return [tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]


def test_words_with_any_signs_after_them():
    signs = [*packing.SIGNS, "...", "###", ",***", ".!!", "'s", "'s.", "'", ".'", "\u2026", "\u0338", "=\u0338", "1.", "-a", "\u00aa!"]
    texts = [f"{w}{s} {s}{w} {s}" for w in ("Abc", "\u00e9t\u00c9", "\u0130x", "stra\u00dfe", "don't", "x1", "e\u0301", "\u65e5\u672c") for s in signs] + ["", " ", None]
    assert _ids(texts) == _whole(texts) and _ids(texts, pa.large_string()) == _whole(texts)


def test_signs_make_no_new_words():
    path = packing.default_vocabulary()
    _ids(["quorbel ### .!! ,*** $$$"])
    known = len(packing._cache[path][0])
    _ids(["quorbel### Quorbel.!! quorbel,*** QUORBEL$$$ quorbel"])
    assert len(packing._cache[path][0]) == known


def test_cache_stays_bounded_and_keeps_the_words_of_the_latest_texts(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    path = packing.default_vocabulary()
    packing._tokenizer(path)
    monkeypatch.setitem(packing._cache, path, (packing._cache[path][0][:0], packing._cache[path][1][:0], packing._cache[path][2][:0]))
    often = ["common words that stay"]
    for k in range(12):
        texts = often + [" ".join(f"{a}{b}ro, {b}{a}k" for a in "abcdefghij"[k % 10] for b in "uvwxyz")]
        assert _ids(texts) == _whole(texts)
        words, sizes, pool = packing._cache[path]
        assert len(words) <= 40 and len(words) == len(sizes) == len(set(words.to_pylist())) and sizes.sum() == len(pool)
        assert {"common", "words", "that", "stay"} <= set(words.to_pylist())
