"""Licence lines among ordinary ones, unknown licence text, calibration, defined results."""

import pytest

from memoloom.llm import licences

PROSE = ["The river was wide and the boats were slow.", "Nothing in the town was free of dust.", "He read the terms aloud, twice.", "Release the birds, said the old man."]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "\n".join([PROSE[i % 4] + f" Day {i}.", PROSE[(i + 1) % 4]])) for i in range(60)]
    rows += [
        (100, "A story.\nReleased under the MIT License.\nThe end."),
        (101, "Licensed under the Apache License, Version 2.0."),
        (102, "x\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."),
        (103, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met"),
        (104, "You may copy, modify, merge and distribute this Frobnicator License software, subject to permission notice of the Frobnicator copyright holder, without warranty"),
        (105, None),
        (106, ""),
        (107, "word " * 100_000 + "\nReleased under the MIT License."),
        (108, "Licensed under the GNU Affero General Public License, version 3."),
        (None, "Released under the MIT License."),
        (100, "another text"),
        (109, "Released under the MIT License."),
        (109, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, family string, line long")
    return [tuple(r) for r in licences.document_licences(df).collect()]


def families(found, doc_id):
    return sorted(r[1] for r in found if r[0] == doc_id)


@pytest.mark.parametrize(
    "doc_id, want",
    [(100, ["", "mit"]), (101, ["apache-2.0"]), (102, ["cc-by-nc,gpl"]), (103, ["bsd"]), (105, [""]), (106, [""]), (107, ["mit"]), (108, ["agpl"]), (None, ["mit"]), (109, ["mit", "mit"])],
)
def test_families(found, doc_id, want):
    assert families(found, doc_id) == want


def test_ordinary_text_has_none(found):
    assert all(r[1:4] == ("", 0, 0) for r in found if r[0] is not None and r[0] < 60)
    assert len(found) == 73


def test_unconfirmed_licence_is_unknown(found):
    row = next(r for r in found if r[0] == 104)
    assert row[1] == "" and row[2] == row[3]


def test_probabilities(found):
    assert all(0 <= r[4] <= 1 for r in found)
    assert all(r[4] > 0.5 for r in found if r[1])


def test_no_documents(spark):
    assert licences.document_licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_scan_is_native(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = licences.document_licences(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
