"""The mail of communities is made once for each read, however often the read needs it."""

import pytest

from mailweave.plans import findings, findings_queries
from mailweave.tables import driver_archive

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["community_messages", "community_view"])
def test_read_uses_a_table(spark, monkeypatch, name):
    seen, kept = [], getattr(findings, name)

    def read(a, f, *rest):
        seen.append(f.community_messages)
        return kept(a, f, *rest)

    monkeypatch.setattr(findings, name, read)
    a = driver_archive(spark, SF)
    getattr(findings_queries, name)(a)
    # recipients, which that mail is made from, aren't read again
    assert len(seen) == 1 and not any("lineitem" in x or "orders" in x for x in seen[0].inputFiles())
    want = findings_queries.planted(a).community_messages
    assert sorted(map(tuple, seen[0].select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_pages_of_a_view_are_tables(spark):
    a = driver_archive(spark, SF)
    f = findings_queries.held(findings_queries.planted(a))
    view = findings.community_view(a, f, f.community_messages.first()["community_id"])
    assert not any("lineitem" in x or "orders" in x for x in view.edges.inputFiles())
