import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import kernel as K

from .helpers import WORD, lower

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aA bB\n\t\x0b\x0céß日🙂.,"), max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    got, hashes = [], {}
    for docs in K.slices(pa.array(texts, pa.string()), limit):
        w = K.Words(docs, lower=True)
        raw = docs.data.tobytes()
        for i in range(docs.n):
            mine = range(w.per_doc[i], w.per_doc[i + 1])
            got.append([raw[w.starts[k] : w.ends[k]].decode() for k in mine])
            for k in mine:
                hashes.setdefault(lower(raw[w.starts[k] : w.ends[k]].decode()), set()).add(int(w.hashes[k]))
    assert got == [WORD.findall(t or "") for t in texts]
    assert all(len(h) == 1 for h in hashes.values())
    assert len({next(iter(h)) for h in hashes.values()}) == len(hashes)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_grams_stay_in_their_document(texts):
    for docs in K.slices(pa.array(texts, pa.string())):
        w = K.Words(docs, lower=False)
        at, h = w.grams(3)
        expected = [k for i in range(docs.n) for k in range(w.per_doc[i], w.per_doc[i + 1] - 2)]
        assert at.tolist() == expected
        seen = {}
        raw = docs.data.tobytes()
        for k, x in zip(at, h):
            seen.setdefault(tuple(raw[w.starts[j] : w.ends[j]] for j in range(k, k + 3)), set()).add(int(x))
        assert all(len(x) == 1 for x in seen.values()) and len(set().union(*seen.values()) if seen else set()) == len(seen)


def test_code_points():
    data = np.frombuffer("aé日🙂".encode(), np.uint8)
    assert K.code_points(data).sum() == 4
