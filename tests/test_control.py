import io
from datetime import datetime, timedelta, timezone

import pytest

from feedweir.control import identity
from feedweir.control.config import Config
from feedweir.control.errors import ApiError
from feedweir.control.jobs import Imports
from feedweir.control.service import Service
from feedweir.control.store import Conflict, Store
from feedweir.schema import REQUIRED
from feedweir.sources import datagen

HEAD = ",".join(REQUIRED) + "\n"
SECRETS = {"token_secret": "s" * 32, "staff_code": "letmein!"}


class Clock:
    def __init__(self):
        self.now = datetime(2025, 5, 1, tzinfo=timezone.utc)

    def __call__(self):
        self.now += timedelta(milliseconds=1)
        return self.now


@pytest.fixture
def setup(spark, tmp_path):
    clock = Clock()
    store = Store(spark, str(tmp_path / "store"))
    return store, Imports(store, Config(batch_rows=50, **SECRETS), str(tmp_path / "up"), clock), clock


def send(imports, body: str, merchant="m", name="f.csv"):
    return imports.submit(merchant, "u", name, io.BytesIO(body.encode()))


def test_import_report_and_resubmission(setup):
    store, imports, _ = setup
    body = HEAD + "A,n,c,1.00,USD,1,2025-03-01T00:00:00Z\nB,n,c,x,USD,1,2025-03-01T00:00:00Z\nA,newer,c,2.00,USD,1,2025-03-02T00:00:00Z\n"
    record, again = send(imports, body)
    assert not again and imports.process_next() and not imports.process_next()
    record = imports.get(record["id"])
    assert (record["status"], record["rows_read"], record["rows_applied"], record["rows_superseded"], record["rows_rejected"]) == ("completed", 3, 1, 1, 1)
    assert send(imports, body, name="other.csv")[1] and not send(imports, body, merchant="m2")[1]
    r = store.table("import_rejections", record["id"]).first()
    assert (r["row_number"], r["line_number"], r["error_code"], r["column_name"]) == (2, 3, "invalid_price", "price")
    send(imports, HEAD + "A,stale,c,9.00,USD,1,2025-03-01T12:00:00Z\n")
    while imports.process_next():
        pass
    p = store.table("products", "m").first()
    assert (p["name"], str(p["price"])) == ("newer", "2.0000")


def test_windows_pause_and_resume_give_the_same_tally(setup, tmp_path):
    store, imports, clock = setup
    datagen.write_feed(str(tmp_path / "g.csv"), rows_wanted=300, bad_rate=0.1, dupe_rate=0.2)
    body = (tmp_path / "g.csv").read_text()
    whole, _ = send(imports, body, "whole")
    imports.process_next()
    small = Imports(store, Config(batch_rows=50, window_bytes=9_000, **SECRETS), imports.folder, clock)
    parts, _ = send(small, body, "parts")
    windows = []
    small.process_next(should_stop=lambda: bool(windows), on_window=windows.append)
    paused = small.get(parts["id"])
    assert paused["status"] == "processing" and paused["locked_by"] is None and 0 < paused["bytes_processed"] < paused["size_bytes"]
    small.process_next()
    names = ("status", "rows_read", "rows_applied", "rows_superseded", "rows_rejected", "rows_unparseable")
    a, b = imports.get(whole["id"]), small.get(parts["id"])
    assert [a[n] for n in names] == [b[n] for n in names] and b["attempts"] == 2
    assert a["rows_read"] == a["rows_applied"] + a["rows_superseded"] + a["rows_rejected"] == 300
    keys = ("sku", "name", "price", "updated_at")
    assert sorted(map(tuple, store.table("products", "whole").select(*keys).collect())) == sorted(map(tuple, store.table("products", "parts").select(*keys).collect()))


def test_products_are_written_in_few_layers(setup, monkeypatch):
    """Windows add layers that swallow each other by weight; the table is that of one merge, whatever the layers."""
    store, imports, clock = setup
    at = lambda i: f"2025-03-{1 + i % 28:02}T{i % 24:02}:00:00Z"
    rows = [f"S{(i * 7) % 60},n{i},c,{i}.00,USD,1,{at(i * 5)}\n" for i in range(600)]
    small = Imports(store, Config(batch_rows=50, window_bytes=2_200, **SECRETS), imports.folder, clock)
    record, _ = send(small, HEAD + "".join(rows), "layers")
    counts = []
    small.process_next(on_window=lambda r: counts.append(len(store.folders("products")["layers"])))
    assert len(counts) >= 8 and max(counts) <= 4 and store.folders("products")["layers"][0].startswith("products/w8-")
    send(imports, HEAD + "".join(rows), "whole")
    imports.process_next()
    found = [sorted(map(tuple, store.table("products", m).select("sku", "name", "updated_at").collect())) for m in ("layers", "whole")]
    assert found[0] == found[1] and len(found[0]) == 60
    # another import of the merchant commits between reading and writing: nothing is lost, the import comes again
    one, _ = send(imports, HEAD + "S1,late,c,1.00,USD,1,2026-01-01T00:00:00Z\n", "whole")
    layered = Store.layered

    def overtaken(self, before, fresh):
        after = layered(self, before, fresh)
        self.commit(replace={"products": {"whole": [*before, store.write_folder("products", store.table("products", "layers").limit(1).replace("layers", "whole", "merchant_id"))]}})
        return after

    monkeypatch.setattr(Store, "layered", overtaken)
    imports.process_next()
    assert imports.get(one["id"])["status"] == "processing" and "came between" in imports.get(one["id"])["error"] and imports.get(one["id"])["attempts"] == 0
    monkeypatch.setattr(Store, "layered", layered)
    imports.process_next()
    assert imports.get(one["id"])["status"] == "completed" and store.table("products", "whole").where("name = 'late'").count() == 1


def test_unusable_files_missing_files_and_retries(setup, tmp_path):
    store, imports, clock = setup
    bad, _ = send(imports, "sku,name\nA,n\n")
    imports.process_next()
    assert imports.get(bad["id"])["status"] == "failed" and "category" in imports.get(bad["id"])["error"]
    gone, _ = send(imports, HEAD + "A,n,c,1,USD,1,2025-03-01T00:00:00Z\n")
    import os

    os.unlink(gone["storage_path"])
    imports.process_next()
    assert imports.get(gone["id"])["error"] == "Uploaded file is no longer on disk"
    flaky, _ = send(imports, HEAD + "B,n,c,1,USD,1,2025-03-01T00:00:00Z\n")

    def fail(*_a, **_b):
        raise RuntimeError("disk on fire")

    imports.run = fail
    for _ in range(5):
        assert imports.process_next()
    assert imports.get(flaky["id"])["status"] == "failed" and imports.get(flaky["id"])["error"] == "After 5 attempts: disk on fire"
    assert not imports.process_next()


def test_cancel_and_leases(setup):
    _, imports, clock = setup
    row = "A,n,c,1,USD,1,2025-03-01T00:00:00Z\n"
    one, _ = send(imports, HEAD + row)
    assert imports.request_cancel(one["id"])["status"] == "cancelled" and imports.request_cancel(one["id"]) is None and imports.claim() is None
    two, _ = send(imports, HEAD + row + row)
    assert imports.claim()["attempts"] == 1 and imports.claim() is None
    clock.now += timedelta(seconds=31)
    assert imports.claim()["attempts"] == 2
    assert imports.request_cancel(two["id"])["status"] == "processing"
    clock.now += timedelta(seconds=31)
    assert imports.claim() is None and imports.sweep_cancelled() == [two["id"]] and imports.get(two["id"])["status"] == "cancelled"


def test_commits_exclude_each_other(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.commit({"users": {"1": {"id": "1"}}}, expect=0)
    with pytest.raises(Conflict):
        b.commit({"users": {"2": {"id": "2"}}}, expect=0)
    for i in range(60):
        a.commit({"users": {str(i): {"id": str(i)}}})
    assert len(Store(spark, str(tmp_path)).records("users")) == 60 == len(b.records("users"))


def test_accounts(setup):
    store, _, clock = setup
    accounts = identity.Accounts(store, Config(**SECRETS), clock)
    made = accounts.register("Ann@x.org", "correct horse", merchant_name="Acme & Söhne")
    assert store.records("merchants")[made["user"]["merchantId"]]["slug"] == "acme-s-hne"
    for call, status in [
        (lambda: accounts.register("ann@X.org", "correct horse", merchant_name="Other"), 409), (lambda: accounts.register("b@x.org", "short", merchant_name="Other"), 400),
        (lambda: accounts.register("b@x.org", "correct horse", staff_code="wrong code"), 403), (lambda: accounts.login("ann@x.org", "wrong"), 401), (lambda: accounts.login("no@x.org", "wrong"), 401),
        (lambda: accounts.authenticate(None), 401), (lambda: accounts.authenticate("Bearer x.y.z"), 401),
    ]:
        with pytest.raises(ApiError) as e:
            call()
        assert e.value.status == status
    session = accounts.login("ANN@x.org", "correct horse")
    caller = accounts.authenticate(f"Bearer {session['accessToken']}")
    assert accounts.me(caller)["merchant"]["name"] == "Acme & Söhne"
    fresh = accounts.refresh(session["refreshToken"])
    with pytest.raises(ApiError):
        accounts.refresh(session["refreshToken"])
    accounts.logout(fresh["refreshToken"])
    with pytest.raises(ApiError):
        accounts.refresh(fresh["refreshToken"])
    clock.now += timedelta(hours=1)
    with pytest.raises(ApiError):
        accounts.authenticate(f"Bearer {session['accessToken']}")


def test_tokens_that_are_forged():
    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    token = identity.issue_access_token(identity.Caller("u", "merchant_user", "m"), "k" * 32, now, 60)
    assert identity.verify_access_token(token, "k" * 32, now).merchant_id == "m"
    head, body, mark = token.split(".")
    none = identity._b64(b'{"alg":"none"}')
    for forged in (f"{none}.{body}.", f"{head}.{body}.{'A' * len(mark)}", f"{head}.{identity._b64(b'{}')}.{mark}", "a.b"):
        with pytest.raises(identity.InvalidToken):
            identity.verify_access_token(forged, "k" * 32, now)
    with pytest.raises(identity.InvalidToken):
        identity.verify_access_token(token, "x" * 32, now)


def test_passwords():
    stored = identity.hash_password("pässword-long")
    assert stored.startswith("scrypt$16384$8$1$") and identity.verify_password("pässword-long", stored)
    assert not identity.verify_password("other", stored) and not identity.verify_password("x", "junk")


def test_service_keeps_tenants_apart(setup):
    store, imports, clock = setup
    accounts, service = identity.Accounts(store, Config(**SECRETS), clock), Service(imports)
    who = lambda **k: accounts.authenticate("Bearer " + accounts.register(k.pop("email"), "correct horse", **k)["accessToken"])
    a, b, staff = who(email="a@x.org", merchant_name="Aa"), who(email="b@x.org", merchant_name="Bb"), who(email="s@x.org", staff_code="letmein!")
    body = (HEAD + "A,n,c,1.00,USD,1,2025-03-01T00:00:00Z\nB,n,c,-1,USD,1,2025-03-01T00:00:00Z\n").encode()
    sent = service.submit(a, [("f.csv", io.BytesIO(body))])[0]
    imports.process_next()
    assert service.get_import(a, sent["id"])["progress"]["fraction"] == 1.0
    assert service.rejections_json(staff, sent["id"])["totalRejected"] == 1 and len(list(service.rejections_csv(a, sent["id"]))) == 2
    assert service.products(a).count() == 1 and service.products(b).count() == 0 and service.products(staff).count() == 1 and service.list_imports(b).count() == 0
    for call, status in [
        (lambda: service.get_import(b, sent["id"]), 404), (lambda: service.products(b, a.merchant_id), 403), (lambda: service.submit(staff, [("f", io.BytesIO(body))]), 400),
        (lambda: service.submit(b, [("f", io.BytesIO(body))], a.merchant_id), 403), (lambda: service.cancel(a, sent["id"]), 409), (lambda: service.submit(a, [("f", io.BytesIO(b""))]), 400), (lambda: service.list_imports(a, limit=101), 400),
    ]:
        with pytest.raises(ApiError) as e:
            call()
        assert e.value.status == status
    assert service.health()["status"] == "ok"


def test_migrations_run_once_and_must_not_change(setup):
    from feedweir.control import migrations

    store, _, clock = setup
    ran = []
    steps = {"0002_b": lambda s: ran.append("b"), "0001_a": lambda s: ran.append("a")}
    assert migrations.migrate(store, steps, clock) == ["0001_a", "0002_b"] and ran == ["a", "b"]
    assert migrations.migrate(store, steps, clock) == [] and list(migrations.applied(store)) == ["0001_a", "0002_b"]
    with pytest.raises(migrations.ChangedMigration):
        migrations.migrate(store, {"0001_a": lambda s: None}, clock)
