"""Sessions, devices and contracts of users: repeated requests, nulls and empty tables."""

from pactline.operators import access

SESSION = "id long, user_id long, device_id long, revoked boolean, reason string"


def test_first_request_of_a_user_ends_the_others(spark):
    s = spark.createDataFrame([(1, 1, 1, False, ""), (2, 1, 1, False, ""), (3, 1, 1, True, "x"), (4, 2, 1, False, ""), (5, None, 1, False, "")], SESSION)
    asks = spark.createDataFrame([(9, 1, 1), (8, 1, 2), (7, None, 5), (6, 2, None), (5, 7, 7)], "at long, user_id long, session_id long")
    got = {r.id: (r.revoked, r.reason, r.ended_by) for r in access.others_ended(s, asks).collect()}
    assert got == {1: (True, "diger", 2), 2: (False, "", None), 3: (True, "x", None), 4: (False, "", None), 5: (False, "", None)}
    assert access.others_ended(s.limit(0), asks).count() == 0
    assert access.others_ended(s, asks.limit(0)).where("revoked").count() == 1


def test_own_devices_go_with_their_sessions(spark):
    d = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (None, 1)], "id long, user_id long")
    s = spark.createDataFrame([(1, 1, 1, False, ""), (2, 9, 1, False, ""), (3, 1, 3, False, ""), (4, 1, None, False, ""), (5, 1, 1, True, "x")], SESSION)
    asks = spark.createDataFrame([(1, 1), (1, 1), (1, 3), (1, None), (None, 2)], "user_id long, device_id long")
    devices, sessions = access.devices_removed(d, s, asks)
    assert sorted(r.id or 0 for r in devices.collect()) == [0, 2, 3]
    assert {r.id: r.reason for r in sessions.collect()} == {1: "cihaz", 2: "cihaz", 3: "", 4: "", 5: "x"}


def test_visible(spark):
    c = spark.createDataFrame([(1, 1, None, "a"), (2, 1, 5, "b"), (3, 2, 5, "c")], "id long, user_id long, org_id long, status string")
    u = spark.createDataFrame([(1, None), (2, 5), (2, 5)], "id long, org_id long")
    asks = spark.createDataFrame([(a, b) for a in (1, 2, 3, None) for b in (1, 2, 3, 4, None)], "user_id long, contract_id long")
    rows = access.visible(c, u, asks).collect()
    assert len(rows) == 20
    assert {(r.user_id, r.contract_id) for r in rows if r.contract} == {(1, 1), (2, 2), (2, 3)}
