"""Records of both channels in one shape, and approvals hashed on from stored chains."""

import datetime as dt
import decimal

from ledgerloom.operators import audit, records

ENTRY = "chain_id long, sequence long, timestamp string, actor_id string, action string, entity_type string, entity_id string, payload string"


def test_receipts_keep_vendor_and_business(spark):
    reviewed = spark.createDataFrame(
        [(1, 7, "Orion", None, None, decimal.Decimal("10.50"), dt.date(2026, 2, 1), "INV-1"), (2, 7, None, "rent", "not recovered: vendor_name", None, None, None), (3, 8, "Acme", "rent", None, decimal.Decimal("1.00"), dt.date(2026, 3, 1), "INV-3")],
        "doc_id long, business_id long, vendor_name string, category string, reject_reason string, amount decimal(28,2), due_date date, source_reference string",
    )
    rows = spark.createDataFrame(
        [("a", "in", 9, decimal.Decimal("5.00"), dt.date(2026, 1, 3), dt.date(2026, 1, 3), "Blue Lake", None, False, 1.0, "bank_statement", "ACC")],
        "record_id string, kind string, business_id long, amount decimal(28,2), due_date date, settled_date date, counterparty_name string, category string, is_receivable boolean, certainty double, source_type string, source_reference string",
    )
    out = {r.record_id: r for r in records.records_union(reviewed, rows).collect()}
    assert set(out) == {"receipt-1", "receipt-3", "a"}
    assert (out["receipt-1"].business_id, out["receipt-1"].counterparty_name, out["receipt-1"].category, out["receipt-1"].certainty) == (7, "Orion", "uncategorized", None)
    assert out["receipt-3"].category == "rent" and out["receipt-3"].settled_date is None and out["receipt-3"].due_date == dt.date(2026, 3, 1)
    assert (out["a"].is_receivable, out["a"].certainty, out["a"].due_date, out["a"].business_id) == (False, 1.0, None, 9)


def test_approvals_continue_their_chains(spark):
    entries = [(c, s, f"t{s}", "system", "login", "event", str(s), "{}") for c, n in ((1, 3), (2, 1)) for s in range(n)]
    chain = audit.append(spark.createDataFrame(entries, ENTRY)).cache()
    asked = [(10, 1, "OWNER"), (11, 1, "STAFF"), (12, 1, "OWNER"), (13, 2, "OWNER"), (14, 3, "OWNER")]
    requests = spark.createDataFrame([(n, c, r, f"a{n}", "owner", "invoice", str(n), "{}") for n, c, r in asked], "request_no long, chain_id long, role string, timestamp string, actor_id string, entity_type string, entity_id string, payload string")
    added = audit.approve(requests, chain)
    assert sorted((r.chain_id, r.sequence, r.entity_id, r.action) for r in added.collect()) == [(1, 3, "10", "approve"), (1, 4, "12", "approve"), (2, 1, "13", "approve"), (3, 0, "14", "approve")]
    whole = chain.unionByName(added.select(*chain.columns))
    assert all(r.intact for r in audit.verify(whole).collect()) and whole.count() == 8
    assert audit.approve(requests.limit(0), chain).count() == 0
