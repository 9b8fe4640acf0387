"""Every occurrence of a notice is found."""

import pytest

from mailweave.llm import license_scan


@pytest.mark.parametrize("between", [" ", " Some words. ", " filler" * 300 + " "])
@pytest.mark.parametrize("name", ["mit", "proprietary", "mit-notice"])
def test_equal_notices(between, name):
    notice = license_scan.TEMPLATES[name]
    text = "Start. " + notice + between + notice + between + notice
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    found = [x for x in scanner.scan(text) if x[0] == name]
    want, at = [], -1
    while (at := text.find(notice, at + 1)) >= 0:
        want.append((at, at + len(notice.rstrip("."))))
    assert [x[2:] for x in found] == want
