import random

import pytest

from lectern.llm import people

AUTHORS = "id string, orcid string, display_name string, display_name_alternatives array<string>, last_known_institutions array<struct<id: string>>, affiliations array<struct<institution: struct<id: string>>>, extra int"
PAPERS = "paper_key long, professor_id string, authors array<string>, retrieved_at timestamp"
PROFESSORS = "professor_id string, openalex_author_id string, updated_at timestamp, row_id long"


def found(spark, path, authors, papers=(), professors=()):
    rows = [(i, o, n, alt, [(p,) for p in places] if places is not None else None, None, 1) for i, o, n, alt, places in authors]
    spark.createDataFrame(rows, AUTHORS).repartition(3).write.parquet(f"{path}/authors_page.parquet")
    spark.createDataFrame([(k, p, a, None) for k, p, a in papers], PAPERS).write.parquet(f"{path}/evidence_papers.parquet")
    spark.createDataFrame([(p, a, None, 1) for p, a in professors], PROFESSORS).write.parquet(f"{path}/professors.parquet")
    out = [(r.id_a, r.id_b) for r in people.p5_found(spark, str(path)).collect()]
    assert len(out) == len(set(out)) and all(a < b for a, b in out)
    return set(out)


def test_one_person_homonyms_and_entries(spark, tmp_path):
    # Given names are known by being common.
    rnd = random.Random(6)
    crowd = [(f"https://x/A9{i:03d}", None, f"{g} {''.join(rnd.choices('bcdfghklmnprstvz', k=9)).title()}", None, None) for i, g in enumerate(["Leila", "Quentin", "Bruno"] * 30)]
    authors = [
        ("https://x/A1", "o1", "Leila Xakamevone", ["Xakamevone, L."], ["I1"]), ("A2", None, "Xakamevone Leila", None, ["https://x/I1"]), ("A3", "https://o/o3", "Leila Xakamevone", None, ["I3"]),
        ("A4", None, "leila xakamevoen", [None], ["I3"]), ("A5", "o5", "William Sevu-Luholmo", None, None), ("A6", "o5", "B. Different", None, None), ("A7", None, "Quentin Pahodemik", None, None), (None, "o9", "Nobody", None, None), ("A8", None, None, None, None),
    ]
    papers = [(1, "P1", ["Bill SevuLuholmo", None, "Quentin Pahodmeik", ""]), (2, "P1", ["Leila Xakamevone"]), (3, "P3", ["L. Xakamevone", "Stranger Unknown"]), (4, None, None)]
    got = found(spark, tmp_path, authors + crowd, papers, [("P1", "A1"), ("P3", "https://x/A3"), (None, None)])
    assert {p for p in got if p[1][0] == "A"} == {("A1", "A2"), ("A3", "A4"), ("A5", "A6")}
    assert {p for p in got if p[1][0] == "E"} == {("A5", "E1-1"), ("A6", "E1-1"), ("A7", "E1-3"), ("A1", "E2-1"), ("A2", "E2-1"), ("A3", "E3-1"), ("A4", "E3-1")}


def test_a_name_of_very_many_stays_linear(spark, tmp_path):
    many = [(f"A{i:05d}", f"o{i}", "Leila Xakamevone", None, [f"I{i % 7}"]) for i in range(3000)]
    assert found(spark, tmp_path, many, [(1, None, ["Leila Xakamevone"])]) == set()


@pytest.mark.parametrize("authors,papers", [([], []), ([("A1", None, "Leila Xakamevone", None, None)], []), ([], [(1, "P", ["Leila Xakamevone"])])])
def test_empty_tables(spark, tmp_path, authors, papers):
    assert found(spark, tmp_path, authors, papers) == set()


def test_linking_with_the_best_ones_loses_little(spark, sf):
    def pairs(all_links):
        stars, _ = people.people(spark, sf, all_links)
        by = {}
        for r in stars.collect():
            by.setdefault(r.center, []).append(r.id)
        return {(a, b) for ids in by.values() for a in ids for b in ids if a < b}

    ours, full = pairs(False), pairs(True)
    assert full and len(ours & full) >= 0.95 * len(full)
