"""Every query of the library against SQL over the driver's smallest tables; those without SQL against plain Python."""

import re

import pytest

from lodestone.operators import chunks
from lodestone.plans import catalog, catalog_index, catalog_readers  # noqa: F401
from tests.oracle import rows_of, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


def test_cells_find_most_neighbours(spark, sf):
    row = catalog.QUERIES["vector_cells_recall"](spark, sf).first()
    assert row.queries == 100 and row.recall >= 0.9 and row.share_read <= 1
    got = catalog.QUERIES["vector_cells"](spark, sf).collect()
    asked = rows_of("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0", sf)[1]
    assert {r.vec_id for r in got} == {i for (i,) in asked} and all(r.neighbour == r.vec_id and r.score > 0.999 for r in got if r["rank"] == 1)


def test_cover_density_against_all_spans(spark, sf):
    terms, want = ("and", "of", "the"), {}
    for i, text in rows_of("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", sf)[1]:
        places = [(k, w) for k, w in enumerate(re.findall(r"\w+", text.lower())) if w in terms]
        if {w for _, w in places} != set(terms):
            continue
        last, score, ended = {}, 0.0, -1
        for p, w in places:
            last[w] = p
            if len(last) == 3 and min(last.values()) > ended:
                ended = min(last.values())
                score += 1 / (p - ended + 1)
        want[i] = round(score, 9)
    got = catalog.QUERIES["fts_cover_density"](spark, sf).collect()
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:50]
    assert sorted((r.doc_id, r.score) for r in got) == sorted(best)


def test_chunk_split_against_a_budget_checker(spark, sf):
    """Parts join to the text, keep both budgets, and no two neighbours would fit together where no lexeme was cut."""
    texts = dict(rows_of("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", sf)[1])
    got = {}
    for r in catalog.QUERIES["chunk_split"](spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.part_index] = r.part
    lexemes = lambda t: [x for x in chunks._PIECE.findall(t) if x.strip()]
    assert sorted(got) == sorted(texts)
    for i, parts in got.items():
        parts = [parts[k] for k in range(len(parts))]
        assert "".join(parts) == texts[i]
        assert len(parts) == 1 or all(0 < len(p.encode()) <= 2048 and len(lexemes(p)) <= 120 for p in parts)
        for a, b in zip(parts, parts[1:]):
            first = chunks._PIECE.findall(b)[0]
            assert len((a + first).encode()) > 2048 or len(lexemes(a)) + (1 if first.strip() else 0) > 120
