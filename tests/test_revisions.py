import random

from quire.operators import revisions as R
from quire.plans.relational import revised
from quire.session import materialize
from quire.sources.pdf import extract


def test_every_state_of_a_file(spark):
    """Three or more revisions, one that leads back to the newest, and one alone."""
    made = [(str(k), bytearray(revised(k, [f"t{n}" for n in range(count)]))) for k, count in ((0, 4), (1, 5), (2, 1))]
    held = R.in_force(materialize(extract(spark.createDataFrame(made, "doc_id string, content binary"), "xref_sections"), "sections")).cache()
    for k, count in ((0, 4), (1, 5), (2, 1)):
        for r in range(count):
            got = {x.obj_num: x for x in R.as_of(held, r).where(f"doc_id = '{k}'").collect()}
            assert sorted(got) == list(range(6 + r)) and got[5].since == got[5].until == r
            assert bytes(made[k][1])[got[5].offset :].split(b"endobj")[0].endswith(b"(t%d) >>\n" % r)
    assert R.as_of(held, 9).count() == 0


def test_first_entry_of_a_section_counts(spark):
    entry = "array<struct<obj_num: long, entry_type: string, offset: long, gen_or_index: long>>"
    rows = [("d", 100, 50, True, [(1, "free", 7, 0), (1, "in_use", 8, 0)]), ("d", 50, None, False, [(1, "in_use", 9, 0), (2, "in_use", 3, 0)]), ("e", 5, 5, True, [])]
    held = R.in_force(spark.createDataFrame(rows, f"doc_id string, start long, prev long, newest boolean, entries {entry}"))
    assert sorted((r.obj_num, r.offset, r.since, r.until) for r in held.collect()) == [(1, 7, 1, 1), (1, 9, 0, 0), (2, 3, 0, 1)]


ENTRIES = "array<struct<obj_num: long, entry_type: string, offset: long, gen_or_index: long>>"


def test_rows_and_ranks_agree(spark):
    """Sections in order are taken in their row, others (the last file's: 90 leads to 300,
    that to 20) by ranks; whichever way, the same entries hold."""
    rng, rows = random.Random(3), []
    for d in range(40):
        starts = [900 - 100 * k for k in range(rng.randrange(1, 6))]
        for k, at in enumerate(starts):
            prev = starts[k + 1] if k + 1 < len(starts) else rng.choice([None, starts[0], starts[-1]])
            rows.append((f"d{d}", at, prev, k == 0, [(rng.randrange(4), "in_use", rng.randrange(99), 0) for _ in range(rng.randrange(6))]))
    rows += [("x", 90, 300, True, [(1, "in_use", 1, 0)]), ("x", 300, 20, False, [(1, "in_use", 2, 0)]), ("x", 20, None, False, [(1, "in_use", 3, 0), (2, "free", 4, 0)])]
    df = spark.createDataFrame(rows, f"doc_id string, start long, prev long, newest boolean, entries {ENTRIES}")
    held = lambda x: sorted(map(tuple, x.collect()))
    got = held(R.in_force(df))
    assert got == held(R._by_ranks(df)) and len(got) > 100
    assert [r[3:] for r in got if r[0] == "x"] == [(1, 0, 2, 2), (2, 0, 1, 1), (3, 0, 0, 0), (4, 0, 0, 2)]


def test_files_in_order_are_not_exchanged(spark):
    made = [(str(k), bytearray(revised(k, [f"t{n}" for n in range(3)]))) for k in range(4)]
    held = R.in_force(extract(spark.createDataFrame(made, "doc_id string, content binary"), "document_sections"))
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    assert held.count() == 4 * 10
