"""The endpoints over HTTP, as a WSGI application for any server: JSON in and out, uploads as multipart forms read as streams.

    make_server("", 8080, application(spark, root, Config(...)))
"""

from __future__ import annotations

import json
import logging
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import BinaryIO
from urllib.parse import parse_qs

from pyspark.sql import SparkSession

from feedweir.control.config import Config
from feedweir.control.errors import ApiError
from feedweir.control.identity import Accounts
from feedweir.control.jobs import Imports
from feedweir.control.service import Service
from feedweir.control.store import Store

BODY_BYTES, HELD_BYTES, MAX_FIELDS = 1 << 20, 8 << 20, 10
STATUS = {200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 409: "Conflict", 413: "Payload Too Large", 500: "Internal Server Error"}
log = logging.getLogger(__name__)


def _plain(value: object) -> object:
    if isinstance(value, datetime):
        at = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return at.astimezone(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    if isinstance(value, date | Decimal):
        return str(value)
    raise TypeError(f"no JSON for {type(value).__name__}")


class Request:
    def __init__(self, environ: dict):
        self.environ = environ
        self.query = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", ""), keep_blank_values=True).items()}
        self.problems: list[dict] = []

    def body(self) -> dict:
        """The JSON object that was sent."""
        length = int(self.environ.get("CONTENT_LENGTH") or 0)
        if length > BODY_BYTES:
            raise ApiError(413, "payload_too_large", f"a body has {BODY_BYTES} bytes at most")
        try:
            found = json.loads(self.environ["wsgi.input"].read(length) or b"null")
        except ValueError as e:
            raise ApiError(400, "bad_request", "the body is not JSON") from e
        if not isinstance(found, dict):
            raise ApiError(400, "bad_request", "the body is not a JSON object")
        return found

    def problem(self, path: str, message: str) -> None:
        self.problems.append({"path": path, "message": message})

    def checked(self) -> None:
        if self.problems:
            raise ApiError(400, "bad_request", "the request doesn't fit", self.problems)

    def texts(self, body: dict, *names: str) -> list[str]:
        for n in names:
            if not isinstance(body.get(n), str) or not body[n]:
                self.problem(n, "a text is needed")
        self.checked()
        return [body[n] for n in names]

    def number(self, name: str, default: int, most: int) -> int:
        given = self.query.get(name, str(default))
        if not re.fullmatch(r"[0-9]{1,9}", given) or not 1 <= int(given) <= most:
            self.problem(name, f"a whole number from 1 to {most} is needed")
            return default
        return int(given)

    def identifier(self, name: str, given: str | None) -> str | None:
        if given is None:
            return None
        try:
            return str(uuid.UUID(given))
        except ValueError:
            self.problem(name, "not an id")
            return None

    def choice(self, name: str, values: Iterable[str], default: str | None = None) -> str | None:
        given = self.query.get(name, default)
        if given is not None and given not in values:
            self.problem(name, f"one of {', '.join(values)} is needed")
        return given

    def instant(self, name: str) -> datetime | None:
        if name not in self.query:
            return None
        try:
            at = datetime.fromisoformat(self.query[name].replace(" ", "+"))
        except ValueError:
            self.problem(name, "not a time")
            return None
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def parts_of(source: BinaryIO, boundary: bytes, length: int) -> Iterator[tuple[str | None, BinaryIO]]:
    """(file name or None, content) of each part of a multipart form; large contents wait on disk, never in memory."""
    mark, held, left = b"\r\n--" + boundary, b"\r\n", length

    def more() -> bool:
        nonlocal held, left
        piece = source.read(min(left, 1 << 16)) if left else b""
        held, left = held + piece, left - len(piece)
        return bool(piece)

    def until(end: bytes, out: BinaryIO | None) -> None:
        nonlocal held
        while (at := held.find(end)) < 0:
            keep = len(end) - 1
            if out is not None and len(held) > keep:
                out.write(held[:-keep])
                held = held[-keep:]
            if not more():
                raise ApiError(400, "bad_request", "the form ends too early")
        if out is not None:
            out.write(held[:at])
        held = held[at + len(end) :]

    until(mark, None)
    while True:
        while len(held) < 2 and more():
            pass
        if not held.startswith(b"\r\n"):
            return  # the closing mark
        head = tempfile.SpooledTemporaryFile(HELD_BYTES)
        until(b"\r\n\r\n", head)
        head.seek(0)
        name = re.search(rb'content-disposition:[^\r\n]*?;\s*filename="((?:[^"\\]|\\.)*)"', head.read(BODY_BYTES), re.I)
        content = tempfile.SpooledTemporaryFile(HELD_BYTES)
        until(mark, content)
        content.seek(0)
        yield (name[1].decode("utf-8", "replace") if name else None), content


class Application:
    def __init__(self, accounts: Accounts, service: Service):
        self.accounts, self.service = accounts, service
        one = r"/v1/imports/([^/]+)"
        self.routes: list[tuple[str, re.Pattern, Callable]] = [
            (method, re.compile(path), answer)
            for method, path, answer in (
                ("GET", "/health", self.health), ("POST", "/v1/auth/register", self.register), ("POST", "/v1/auth/login", self.login), ("POST", "/v1/auth/token/refresh", self.refresh),
                ("POST", "/v1/auth/logout", self.logout), ("GET", "/v1/auth/me", self.me), ("POST", "/v1/imports", self.submit), ("GET", "/v1/imports", self.list_imports), ("GET", one, self.get_import),
                ("GET", f"{one}/rejections", self.rejections), ("POST", f"{one}/cancel", self.cancel), ("GET", "/v1/products", self.products),
            )
        ]

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        headers = {"Content-Type": "application/json; charset=utf-8"}
        try:
            status, found, extra = self._answer(environ)
            headers |= extra
        except ApiError as e:
            status, found = e.status, e.envelope()
        except Exception:
            log.exception("a request failed")
            status, found = 500, {"error": {"code": "internal_error", "message": "the request failed here"}}
        if status == 204:
            headers, chunks = {}, []
        else:
            chunks = [json.dumps(found, default=_plain).encode()] if isinstance(found, dict) else (line.encode() for line in found)
        start_response(f"{status} {STATUS.get(status, '')}", list(headers.items()))
        return chunks

    def _answer(self, environ: dict) -> tuple[int, dict | Iterable[str], dict]:
        fits = [(m, found, answer) for m, path, answer in self.routes if (found := path.fullmatch(environ.get("PATH_INFO", "")))]
        for method, found, answer in fits:
            if method == environ["REQUEST_METHOD"]:
                out = answer(Request(environ), *found.groups())
                return out if len(out) == 3 else (*out, {})
        raise ApiError(405, "method_not_allowed", "not by that method") if fits else ApiError(404, "not_found", "there is nothing here")

    def _caller(self, r: Request):
        return self.accounts.authenticate(r.environ.get("HTTP_AUTHORIZATION"))

    # accounts

    def health(self, r: Request) -> tuple:
        return 200, self.service.health()

    def register(self, r: Request) -> tuple:
        body = r.body()
        kinds = {"merchant": "merchantName", "staff": "staffRegistrationCode"}
        if body.get("accountType") not in kinds:
            r.problem("accountType", "merchant or staff is needed")
            r.checked()
        email, password, detail = r.texts(body, "email", "password", kinds[body["accountType"]])
        return 201, self.accounts.register(email, password, **{"merchant_name" if body["accountType"] == "merchant" else "staff_code": detail})

    def login(self, r: Request) -> tuple:
        return 200, self.accounts.login(*r.texts(r.body(), "email", "password"))

    def refresh(self, r: Request) -> tuple:
        return 200, self.accounts.refresh(*r.texts(r.body(), "refreshToken"))

    def logout(self, r: Request) -> tuple:
        self.accounts.logout(*r.texts(r.body(), "refreshToken"))
        return 204, {}

    def me(self, r: Request) -> tuple:
        return 200, self.accounts.me(self._caller(r))

    # imports and products

    def submit(self, r: Request) -> tuple:
        caller, merchant = self._caller(r), r.identifier("merchantId", r.query.get("merchantId"))
        r.checked()
        kind = re.fullmatch(r'multipart/form-data\s*;.*?boundary="?([^";]{1,70})"?.*', r.environ.get("CONTENT_TYPE", ""), re.I | re.S)
        if not kind:
            raise ApiError(400, "bad_request", "send files as multipart/form-data")
        made, fields = [], 0
        for name, content in parts_of(r.environ["wsgi.input"], kind[1].encode(), int(r.environ.get("CONTENT_LENGTH") or 0)):
            with content:
                if name is None:
                    fields += 1
                    if fields > MAX_FIELDS:
                        raise ApiError(413, "payload_too_large", f"at most {MAX_FIELDS} fields")
                    continue
                if len(made) == self.service.imports.config.max_files:
                    raise ApiError(413, "payload_too_large", f"at most {len(made)} files")
                made += self.service.submit(caller, [(name, content)], merchant)  # files before one that fails stay
        if not made:
            raise ApiError(400, "bad_request", "no files were sent")
        return 202, {"imports": made}

    def list_imports(self, r: Request) -> tuple:
        caller = self._caller(r)
        merchant, limit, before = r.identifier("merchantId", r.query.get("merchantId")), r.number("limit", 20, 100), r.instant("before")
        status = r.choice("status", ("queued", "processing", "completed", "failed", "cancelled"))
        r.checked()
        rows = self.service.list_imports(caller, merchant, status, limit, before and (before, None)).collect()  # 100 at most
        return 200, {"imports": [x.asDict(recursive=True) for x in rows]}

    def _id(self, r: Request, given: str) -> str:
        found = r.identifier("id", given)
        r.checked()
        return found

    def get_import(self, r: Request, given: str) -> tuple:
        return 200, self.service.get_import(self._caller(r), self._id(r, given))

    def rejections(self, r: Request, given: str) -> tuple:
        caller, form, import_id = self._caller(r), r.choice("format", ("csv", "json"), "csv"), self._id(r, given)
        if form == "csv":
            return 200, self.service.rejections_csv(caller, import_id), {"Content-Type": "text/csv; charset=utf-8", "Content-Disposition": f'attachment; filename="rejections-{import_id}.csv"'}
        found = self.service.rejections_json(caller, import_id)
        items = [{"errorCode" if k == "code" else k: v for k, v in x.items()} for x in found["rejections"]]
        return 200, {"importId": import_id} | found | {"rejections": items}

    def cancel(self, r: Request, given: str) -> tuple:
        caller, import_id = self._caller(r), self._id(r, given)
        self.service.cancel(caller, import_id)
        return 202, self.service.get_import(caller, import_id)

    def products(self, r: Request) -> tuple:
        caller = self._caller(r)
        merchant, limit = r.identifier("merchantId", r.query.get("merchantId")), r.number("limit", 50, 200)
        r.checked()
        return 200, {"products": [x.asDict() for x in self.service.products(caller, merchant, r.query.get("sku"), limit).collect()]}  # 200 at most


def application(spark: SparkSession, root: str, config: Config) -> Application:
    """The endpoints over a store and its uploads below `root`."""
    store = Store(spark, f"{root}/store")
    return Application(Accounts(store, config), Service(Imports(store, config, f"{root}/uploads")))
