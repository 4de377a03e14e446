"""One session for all tests and a small hand-made claims table."""

from __future__ import annotations

import os
import sys
from datetime import date, datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pendscope.operators.measures import add_measures  # noqa: E402
from pendscope.session import local_session  # noqa: E402
from pendscope.sources.claims import ENRICHED_SCHEMA  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FIRST = date(2026, 3, 1)
DAYS = 70
LAST = FIRST + timedelta(days=DAYS - 1)
RISE_FROM = LAST - timedelta(days=20)
QUIET_DAY = FIRST + timedelta(days=10)  # no claim at all


def make_claims() -> list[dict]:
    """A rise of provider_match on platform NORTH from RISE_FROM on; duplicate is
    frequent and quick, medical_records rare and slow; pricing and cob are absent from
    the baseline; one claim is still held, one has neither note nor code."""
    rows: list[dict] = []

    def add(day: date, theme: str | None, hold_days: float = 0.0, stage: str | None = None, released: bool = True, **more) -> None:
        number = len(rows)
        start = datetime(day.year, day.month, day.day) + timedelta(hours=6, minutes=number % 50)
        hold = timedelta(days=hold_days)
        order = ["intake", "pre_adjudication", "adjudication", "post_adjudication"]
        at, ends, began = start, [], None
        for name, hours in zip(order, (6 + 30 * (more.get("channel") == "paper"), 8, 24, 12)):
            if theme and name == stage:
                began = at
                at += hold
            at += timedelta(hours=hours)
            ends.append(at)
        if theme and not released:
            ends = [e if began and e <= began else None for e in ends]
        row = {f.name: None for f in ENRICHED_SCHEMA.fields}
        row |= {
            "claim_id": f"C26{number:08d}", "received_ts": start, "intake_done_ts": ends[0], "preadj_done_ts": ends[1],
            "adjudicated_ts": ends[2], "finalized_ts": ends[3], "lob": ["alpha", "beta", "gamma"][number % 3],
            "platform": ["NORTH", "SOUTH"][number % 2], "channel": "portal", "claim_type": ["short", "long"][number % 2],
            "specialty": f"S{number % 4}", "network_status": "in", "provider_id": f"P{number % 7}", "billed_amount": 100 + number,
            "status": "Paid", "pended": theme is not None, "touches": 0,
        }
        if theme:
            row |= {
                "pended_ts": began, "released_ts": began + hold if released else None, "pend_stage": stage,
                "pend_code": "PND-000" if number % 4 == 0 else "PND-220", "adjuster_note": f"note {number % 5} on {theme}",
                "touches": 2, "true_theme": theme, "true_sub_cause": f"{theme}:{number % 2}", "theme": theme, "confidence": 0.9,
                "cluster_id": f"{theme}:{1 + number % 2}", "status": "Paid" if released else "Pended",
            }
        rows.append(row | more)

    for i in range(DAYS):
        day = FIRST + timedelta(days=i)
        if day == QUIET_DAY:
            continue
        add(day, None, channel="paper" if i % 2 else "portal")
        add(day, None)
        if i % 2 == 0:
            add(day, "duplicate", 0.5, "pre_adjudication")
        if i % 9 == 0:
            add(day, "medical_records", 18.25, "adjudication")
        if i % 3 == 0:
            add(day, "provider_match", 6.0, "pre_adjudication", platform="SOUTH")
        if day >= RISE_FROM:
            for _ in range(3):
                add(day, "provider_match", 6.0, "pre_adjudication", platform="NORTH")
    add(LAST, "pricing", 2.0, "adjudication", cluster_id=None)
    add(LAST, "cob", 1.0, "adjudication", released=False)
    add(LAST, "eligibility", 3.0, "adjudication", adjuster_note=None, pend_code=None)
    add(LAST, "eligibility", 3.0, "adjudication", adjuster_note="100% of .* (x) unclear", denial_code="999", status="Denied")
    add(LAST, "needs_review", 4.0, "intake", cluster_id=None, confidence=0.4)
    return rows


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows() -> list[dict]:
    return make_claims()


@pytest.fixture(scope="session")
def claims(spark, rows):
    from decimal import Decimal

    data = [tuple(Decimal(r[n]) if n == "billed_amount" else r[n] for n in ENRICHED_SCHEMA.fieldNames()) for r in rows]
    return add_measures(spark.createDataFrame(data, ENRICHED_SCHEMA)).persist()
