"""Selectors of page fields, and their compilation into plain steps.

Only the forms that the field lists need are understood: tag, class, id,
attribute and contained text, joined by descendant or next sibling, and three
path forms. Anything else is refused on the driver.
"""

from __future__ import annotations

import re

# --- Fixed values: selectors per field, tried in this order. ---
DETAIL_SELECTORS = {
    "owner_name": [
        "div.owner-info h3",
        "span.owner-name",
        "td:contains('Owner Name') + td",
        "//label[contains(text(), 'Owner')]/following-sibling::span",
    ],
    "parcel_id": [
        "span.parcel-id",
        "td:contains('Parcel ID') + td",
        "div.parcel-number",
        "//label[contains(text(), 'Parcel')]/following-sibling::span",
    ],
    "property_address": [
        "div.property-address",
        "span.address",
        "td:contains('Property Address') + td",
        "//label[contains(text(), 'Property Address')]/following-sibling::span",
    ],
    "mailing_address": [
        "div.mailing-address",
        "span.mailing",
        "td:contains('Mailing Address') + td",
        "//label[contains(text(), 'Mailing Address')]/following-sibling::span",
    ],
    "city": [
        "span.city",
        "td:contains('City') + td",
        "//label[contains(text(), 'City')]/following-sibling::span",
    ],
    "state": [
        "span.state",
        "td:contains('State') + td",
        "//label[contains(text(), 'State')]/following-sibling::span",
    ],
    "zip_code": [
        "span.zip",
        "span.zipcode",
        "td:contains('ZIP') + td",
        "td:contains('Zip Code') + td",
        "//label[contains(text(), 'ZIP')]/following-sibling::span",
    ],
    "assessed_value": [
        "span.assessed-value",
        "td:contains('Assessed Value') + td",
        "td:contains('Total Value') + td",
        "//label[contains(text(), 'Assessed Value')]/following-sibling::span",
    ],
    "sale_date": [
        "span.sale-date",
        "td:contains('Sale Date') + td",
        "td:contains('Last Sale Date') + td",
        "//label[contains(text(), 'Sale Date')]/following-sibling::span",
    ],
    "sale_price": [
        "span.sale-price",
        "td:contains('Sale Price') + td",
        "td:contains('Last Sale Price') + td",
        "//label[contains(text(), 'Sale Price')]/following-sibling::span",
    ],
}

FALLBACK_SELECTORS = {
    "owner_name": [
        "//tr[td[contains(text(), 'Owner')]]/td[2]",
        "//div[contains(@class, 'owner')]//text()",
    ],
    "parcel_id": [
        "//tr[td[contains(text(), 'Parcel')]]/td[2]",
        "//div[contains(@class, 'parcel')]//text()",
    ],
    "property_address": [
        "//tr[td[contains(text(), 'Property Address')]]/td[2]",
        "//tr[td[contains(text(), 'Site Address')]]/td[2]",
    ],
    "assessed_value": [
        "//tr[td[contains(text(), 'Total')]]/td[2]",
        "//tr[td[contains(text(), 'Value')]]/td[2]",
    ],
}

RESULT_ROWS = "table.search-results tbody tr"
RESULT_TABLES = ["table.search-results", "table#property-results"]
PAGE_SOURCE = "Orange County Scraper"
PAGE_COUNTY = "Orange"
# --- End of fixed values. ---


def selectors_for(field: str, with_fallbacks: bool = True) -> list[str]:
    """The selectors of a field in order, primary ones first."""
    extra = FALLBACK_SELECTORS.get(field, []) if with_fallbacks else []
    return [*DETAIL_SELECTORS.get(field, []), *extra]


def is_path(selector: str) -> bool:
    return selector.startswith(("//", "("))


_CSS = re.compile(
    r"(?P<tag>[a-z][a-z0-9]*)?(?:#(?P<id>[\w-]+))?(?P<classes>(?:\.[\w-]+)*)"
    r"(?:\[(?P<attr>[\w-]+)\])?(?::contains\('(?P<contains>[^']*)'\))?"
)
_PATHS = [
    (
        re.compile(r"//(\w+)\[contains\(text\(\), ?'([^']*)'\)\](?:/following-sibling::(\w+))?"),
        lambda m: [(" ", {"tag": m[1], "own": m[2]})] + ([("~", {"tag": m[3]})] if m[3] else []),
    ),
    (
        re.compile(r"//(\w+)\[(\w+)\[contains\(text\(\), ?'([^']*)'\)\]\]/(\w+)\[(\d+)\]"),
        lambda m: [(" ", {"tag": m[1], "child": (m[2], m[3])}), (">", {"tag": m[4], "nth": int(m[5])})],
    ),
    (
        re.compile(r"//(\w+)\[contains\(@class, ?'([^']*)'\)\]//text\(\)"),
        lambda m: [(" ", {"tag": m[1], "class_part": m[2]})],
    ),
]


def compile_selector(selector: str) -> list[tuple[str, dict]]:
    """Steps of (relation to the step before, test)."""
    if is_path(selector):
        for pattern, steps in _PATHS:
            if m := pattern.fullmatch(selector):
                return steps(m)
        raise ValueError(f"unsupported selector {selector!r}")
    steps, relation = [], " "
    for token in re.findall(r"(?:[^\s']|'[^']*')+", selector):
        if token == "+":
            relation = "+"
            continue
        m = _CSS.fullmatch(token)
        if not m:
            raise ValueError(f"unsupported selector {selector!r}")
        test = {k: v for k, v in m.groupdict().items() if v}
        if "classes" in test:
            test["classes"] = test["classes"].strip(".").split(".")
        steps.append((relation, test))
        relation = " "
    return steps
