"""Role changes, invitations and acceptances: rules on small cases."""

from pactline.operators import organisation as o

MEMBERS = [(1, 10, "SAHIP"), (1, 11, "YONETICI"), (1, 12, "IZLEYICI"), (2, 20, "SAHIP"), (3, 30, "IZLEYICI")]


def test_one_owner_is_left_whatever_is_asked(spark):
    members = spark.createDataFrame(MEMBERS, "org long, user long, role string")
    asked = [
        (1, 1, 11, 12, "YONETICI", False), (1, 2, 10, 12, "YONETICI", True), (1, 3, 10, 10, "IZLEYICI", False),  # an owner cannot step down
        (1, 4, 10, 20, "YONETICI", False), (1, 5, 10, 10, "SAHIP", True), (1, 6, 10, 11, "SAHIP", True), (1, 7, 10, 12, "IZLEYICI", False),  # no longer the owner
        (1, 8, 11, 10, "IZLEYICI", True), (1, 9, 11, 99, "SAHIP", False), (1, 10, 11, 12, "KRAL", False), (1, 11, 11, 12, None, False), (1, 12, None, 12, "SAHIP", False), (1, 13, 11, 12, "SAHIP", True),
        (2, 14, 20, 20, "SAHIP", True), (3, 15, 30, 30, "SAHIP", False), (4, 16, 1, 1, "SAHIP", False),
    ]
    requests = spark.createDataFrame([r[:5] for r in asked], "org long, id long, actor long, target long, role string").repartition(3)
    changes = o.role_changes(members, requests)
    assert {r.id: r.accepted for r in changes.collect()} == {r[1]: r[5] for r in asked}
    after = {(r.org, r.user): r.role for r in o.roles_after(members, changes).collect()}
    assert after == {(1, 10): "IZLEYICI", (1, 11): "YONETICI", (1, 12): "SAHIP", (2, 20): "SAHIP", (3, 30): "IZLEYICI"}


def test_invitations_and_acceptances(spark):
    members = spark.createDataFrame(MEMBERS, "org long, user long, role string")
    users = spark.createDataFrame([(1, "a@b.c"), (2, "d@e.f"), (1, None)], "org long, email string")
    asked = [
        (1, 1, 10, " X@Y.z ", "YONETICI", "davet", False), (1, 2, 10, "x@y.z", "IZLEYICI", "davet", True), (1, 3, 11, "x@y.z", "IZLEYICI", "yasak", False), (1, 4, 10, "q@y.z", "SAHIP", "yasak", False),
        (1, 5, 10, "a@b.c", "IZLEYICI", "yok", False), (1, 6, 10, "d@e.f", "IZLEYICI", "davet", True), (1, 7, 10, "kim", "IZLEYICI", "yok", False), (1, 8, 10, None, "IZLEYICI", "yok", False), (2, 9, 20, "x@y.z", "YONETICI", "davet", True), (2, 10, 20, "n@y.z", None, "yasak", False),
    ]
    requests = spark.createDataFrame([r[:5] for r in asked], "org long, id long, actor long, email string, role string").repartition(3)
    invitations = o.invited(members, users, requests)
    assert {r.id: (r.outcome, r.open) for r in invitations.collect()} == {r[1]: r[5:] for r in asked}
    tries = spark.createDataFrame([(1, 1), (2, 9), (3, 2), (4, 9), (5, 6), (6, 77), (7, None)], "id long, invitation long").repartition(2)
    got = {r.id: (r.outcome, r.org, r.role) for r in o.accepted(invitations, users, tries).collect()}
    # 1: closed by a later one; 3: the address became a user of organisation 2; 5: a user elsewhere
    assert got == {1: ("yok", None, None), 2: ("kayit", 2, "YONETICI"), 3: ("yok", None, None), 4: ("yok", None, None), 5: ("yok", None, None), 6: ("yok", None, None), 7: ("yok", None, None)}
    back = spark.createDataFrame([(1, "x@y.z")], "org long, email string")
    assert o.accepted(invitations, back, spark.createDataFrame([(1, 2), (2, 2)], "id long, invitation long")).orderBy("id").first().outcome == "uye"
