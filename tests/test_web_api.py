import io
import json
import os
import signal
import threading
import time
import uuid
from wsgiref.util import setup_testing_defaults

import pytest

from feedweir import __main__ as commands
from feedweir.control import migrations, web
from feedweir.control.config import Config
from feedweir.control.errors import ApiError
from feedweir.control.store import Store
from feedweir.schema import REQUIRED

CONFIG = Config(token_secret="k" * 40, staff_code="open sesame", poll_seconds=0.05)


class Client:
    def __init__(self, app):
        self.app, self.token = app, None

    def __call__(self, method, path, body=None, raw=b"", kind="application/json", query=""):
        data = json.dumps(body).encode() if body is not None else raw
        environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(data)), "CONTENT_TYPE": kind, "wsgi.input": io.BytesIO(data)}
        setup_testing_defaults(environ)
        if self.token:
            environ["HTTP_AUTHORIZATION"] = f"Bearer {self.token}"
        seen = {}
        out = b"".join(self.app(environ, lambda status, headers: seen.update(status=int(status[:3]), headers=dict(headers))))
        return seen["status"], (json.loads(out) if out and "json" in seen["headers"].get("Content-Type", "") else out.decode()), seen["headers"]

    def upload(self, *files, query=""):
        mark = "----edge"
        raw = b"".join(f'--{mark}\r\nContent-Disposition: form-data; name="f"{named}\r\n\r\n'.encode() + data + b"\r\n" for named, data in ((f'; filename="{n}"' if n else "", d) for n, d in files)) + f"--{mark}--\r\n".encode()
        return self("POST", "/v1/imports", raw=raw, kind=f"multipart/form-data; boundary={mark}", query=query)


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    return web.application(spark, str(tmp_path_factory.mktemp("api")), CONFIG)


def register(app, name):
    c = Client(app)
    status, found, _ = c("POST", "/v1/auth/register", {"accountType": "merchant", "email": f"{name}@shop.example", "password": "a long password", "merchantName": name})
    assert status == 201
    c.token, c.refresh, c.merchant = found["accessToken"], found["refreshToken"], found["user"]["merchantId"]
    return c


def test_accounts(app):
    c = register(app, "Anna")
    assert c("GET", "/v1/auth/me")[1]["merchant"]["slug"] == "anna"
    again = {"accountType": "merchant", "email": "ANNA@shop.example", "password": "a long password", "merchantName": "B2"}
    assert c("POST", "/v1/auth/register", again)[0] == 409 and c("POST", "/v1/auth/register", again | {"accountType": "x"})[0] == 400
    assert c("POST", "/v1/auth/register", {"accountType": "staff", "email": "s@x.example", "password": "a long password", "staffRegistrationCode": "wrong code"})[0] == 403
    assert c("POST", "/v1/auth/login", {"email": "anna@shop.example", "password": "no"})[0] == 401
    status, found, _ = c("POST", "/v1/auth/login", {"email": "anna@shop.example"})
    assert status == 400 and found["error"]["details"][0]["path"] == "password"
    assert c("POST", "/v1/auth/login", raw=b"{")[0] == 400 and c("POST", "/v1/auth/login", raw=b"[1]")[0] == 400 and c("POST", "/v1/auth/login", raw=b"x" * (web.BODY_BYTES + 1))[0] == 413
    status, fresh, _ = c("POST", "/v1/auth/token/refresh", {"refreshToken": c.refresh})
    assert status == 200 and fresh["refreshToken"] != c.refresh and c("POST", "/v1/auth/token/refresh", {"refreshToken": c.refresh})[0] == 401
    assert c("POST", "/v1/auth/logout", {"refreshToken": fresh["refreshToken"]})[:2] == (204, "") and c("POST", "/v1/auth/token/refresh", {"refreshToken": fresh["refreshToken"]})[0] == 401
    c.token = "nonsense"
    assert c("GET", "/v1/auth/me")[0] == 401 and c("GET", "/nowhere")[0] == 404 and c("POST", "/health")[0] == 405 and c("GET", "/health")[1]["status"] == "ok"


def test_imports_over_http(app):
    one, two, staff = register(app, "Otto"), register(app, "Tina"), Client(app)
    staff.token = staff("POST", "/v1/auth/register", {"accountType": "staff", "email": "staff@x.example", "password": "a long password", "staffRegistrationCode": CONFIG.staff_code})[1]["accessToken"]
    good = (",".join(REQUIRED) + "\nA,n,c,1.00,USD,1,2025-03-01T00:00:00Z\nB,n,c,x,USD,1,2025-03-01T00:00:00Z\n").encode()
    status, found, _ = one.upload((None, b"a field"), ("a.csv", good), ("same.csv", good))
    assert status == 202 and [x["deduplicated"] for x in found["imports"]] == [False, True]
    made = found["imports"][0]["id"]
    assert one.upload(("e.csv", b""))[0] == 400 and one.upload((None, b"x"))[0] == 400 and one("POST", "/v1/imports", {})[0] == 400 and one.upload(*[("f", good)] * 21)[0] == 413
    assert one("POST", "/v1/imports", raw=b"------edge\r\nno end", kind="multipart/form-data; boundary=----edge")[0] == 400
    assert staff.upload(("a.csv", good))[0] == 400 and two.upload(("a.csv", good), query=f"merchantId={one.merchant}")[0] == 403
    assert app.service.imports.process_next()
    shown = one("GET", f"/v1/imports/{made}")[1]
    assert (shown["status"], shown["result"]["rowsApplied"], shown["result"]["rowsRejected"]) == ("completed", 1, 1) and shown["createdAt"].endswith("Z")
    assert two("GET", f"/v1/imports/{made}")[0] == 404 and one("GET", "/v1/imports/17")[0] == 400 and one("GET", f"/v1/imports/{uuid.uuid4()}")[0] == 404
    status, report, headers = one("GET", f"/v1/imports/{made}/rejections")
    assert status == 200 and headers["Content-Disposition"] == f'attachment; filename="rejections-{made}.csv"' and report.splitlines()[1].startswith("2,3,invalid_price,price,")
    found = one("GET", f"/v1/imports/{made}/rejections", query="format=json")[1]
    assert (found["importId"], found["totalRejected"], found["truncated"], found["rejections"][0]["errorCode"]) == (made, 1, False, "invalid_price")
    assert one("GET", f"/v1/imports/{made}/rejections", query="format=xml")[0] == 400 and one("POST", f"/v1/imports/{made}/cancel")[0] == 409
    queued = one.upload(("b.csv", good + b"C,n,c,1.00,USD,1,2025-03-01T00:00:00Z\n"))[1]["imports"][0]["id"]
    status, found, _ = one("POST", f"/v1/imports/{queued}/cancel")
    assert (status, found["status"], found["cancelRequested"]) == (202, "cancelled", True)
    assert [x["id"] for x in one("GET", "/v1/imports", query="status=completed&limit=5")[1]["imports"]] == [made] and one("GET", "/v1/imports", query="limit=101&status=x&before=soon")[0] == 400
    assert one("GET", "/v1/imports", query="before=2000-01-01T00:00:00Z")[1] == {"imports": []} and len(staff("GET", "/v1/imports")[1]["imports"]) >= 2
    assert [(p["sku"], p["price"]) for p in one("GET", "/v1/products")[1]["products"]] == [("A", "1.0000")] and two("GET", "/v1/products")[1] == {"products": []}
    assert two("GET", "/v1/products", query=f"merchantId={one.merchant}")[0] == 403 and one("GET", "/v1/products", query="limit=0")[0] == 400


@pytest.mark.parametrize("size", [0, 1, 70_000, 200_000])
def test_forms_are_read_as_streams(size):
    data = os.urandom(size) + b"\r\n--edg"
    form = b'preamble\r\n--edge\r\nContent-Disposition: form-data; name="x"; filename="\xc3\xa9.csv"\r\n\r\n' + data + b"\r\n--edge\r\nContent-Disposition: form-data; name=y\r\n\r\nv\r\n--edge--\r\n"
    assert [(n, c.read()) for n, c in web.parts_of(io.BytesIO(form), b"edge", len(form))] == [("é.csv", data), (None, b"v")]
    with pytest.raises(ApiError):
        list(web.parts_of(io.BytesIO(form[:-12]), b"edge", len(form)))


def test_a_worker_stops_at_sigterm(app):
    threading.Thread(target=lambda: (time.sleep(1), os.kill(os.getpid(), signal.SIGTERM))).start()
    before = [signal.getsignal(s) for s in (signal.SIGTERM, signal.SIGINT)]
    try:
        commands.work(app.service.imports)  # returns
    finally:
        for s, f in zip((signal.SIGTERM, signal.SIGINT), before):
            signal.signal(s, f)


def test_commands(spark, tmp_path, capsys):
    commands.main(["generate", str(tmp_path / "f.csv"), "--rows", "20", "--crlf"])
    assert (tmp_path / "f.csv").read_bytes().count(b"\r\n") == 21 and "'rows': 20" in capsys.readouterr().out
    store = Store(spark, str(tmp_path / "store"))
    assert migrations.migrate(store, migrations.STEPS, lambda: __import__("datetime").datetime.now(__import__("datetime").timezone.utc)) == sorted(migrations.STEPS)
    assert set(migrations.applied(store)) == set(migrations.STEPS)
