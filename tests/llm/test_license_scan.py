from stocktake.llm import license_scan as s
from stocktake.llm.license_texts import TEXTS


def test_whole_texts_and_notices(spark, odd_docs, no_docs, prose):
    mit = "Copyright (c) 2020 Someone\n\n" + TEXTS["MIT"][1].replace("software", "SOFTWARE").replace("license", "licence").replace('"AS IS"', "'AS IS'")
    rows = [(1, mit), (2, prose(1, 20) + "\nLicenced under the Apache License, Version 2.0.\n" + prose(2, 9)), (3, "Released under the MIT License.\nLicensed under CC BY-NC 4.0"), (4, "He released under the MIT License. Really"), (5, None), (6, TEXTS["BSD-3-Clause"][0]), (7, TEXTS["BSD-3-Clause"][0] + " more")]
    got = {r.doc_id: r for r in s.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].whole_license == "MIT" and got[1].family == "permissive"
    assert got[2].licenses == "Apache-2.0" and got[2].whole_license is None
    assert got[3].licenses == "CC-BY-NC-4.0,MIT" and got[3].family == "restricted" and got[3].n_licenses == 2
    assert got[4].n_licenses == 0 and got[5].family == "none" and got[7].whole_license is None
    assert got[6].whole_license == "BSD-3-Clause"
    assert s.scan_licenses(odd_docs).count() == odd_docs.count() and s.scan_licenses(no_docs).collect() == []


def test_known_digests_are_unique_and_anchored(spark):
    import re

    known = s.known_texts()
    assert all(re.search(s.ANCHOR, text.lower()) for _, text in known)
    digests = s.known_digests(spark).collect()
    assert len({r.digest for r in digests}) == len(digests)


def test_long_texts_and_headers(spark):
    from pathlib import Path

    common = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    whole = {name: (common / file).read_text() for name, file in files.items()}
    appendix = whole["Apache-2.0"].split('   Licensed under the Apache', 1)[1]
    apache = "Some prose before.\n\n   Licensed under the Apache" + appendix + "\nSome code after."
    start = whole["GPL-3.0"].index("    This program is free software: you can redistribute it")
    gpl = "Some prose before.\n\n" + whole["GPL-3.0"][start : whole["GPL-3.0"].index("Also add information")] + "Some code after."
    start = whole["GPL-2.0"].index("    This program is free software; you can redistribute it")
    gpl2 = whole["GPL-2.0"][start : whole["GPL-2.0"].index("Also add information")]
    rows = [*whole.items(), ("apache", apache), ("gpl", gpl), ("gpl2", gpl2)]
    got = {r.doc_id: r for r in s.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name in files:
        assert got[name].whole_license == name, name
    assert (got["apache"].licenses, got["gpl"].licenses, got["gpl2"].licenses) == ("Apache-2.0", "GPL-3.0", "GPL-2.0")
    assert got["gpl2"].whole_license == "GPL-2.0" and got["apache"].whole_license is None
