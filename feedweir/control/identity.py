"""Accounts: passwords, access and refresh tokens, registration, and the rules between tenants."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import secrets
import unicodedata
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from feedweir.control.config import Config
from feedweir.control.errors import ApiError
from feedweir.control.store import Conflict, Store, now_text
from feedweir.schema import ROLES

# Parameters of stored hashes.
SCRYPT = {"n": 16384, "r": 8, "p": 1}
KEY_BYTES, SALT_BYTES = 64, 16
ISSUER = "feedweir"
EMAIL = re.compile(r"[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+")


def hash_password(password: str, salt: bytes | None = None) -> str:
    salt = salt or secrets.token_bytes(SALT_BYTES)
    key = hashlib.scrypt(unicodedata.normalize("NFKC", password).encode(), salt=salt, **SCRYPT, dklen=KEY_BYTES, maxmem=64 << 20)
    return "$".join(["scrypt", *map(str, SCRYPT.values()), base64.b64encode(salt).decode(), base64.b64encode(key).decode()])


def verify_password(password: str, stored: str) -> bool:
    """Compares in constant time; anything that is no such hash is false."""
    try:
        kind, n, r, p, salt, key = stored.split("$")
        if kind != "scrypt":
            return False
        expected = base64.b64decode(key)
        found = hashlib.scrypt(unicodedata.normalize("NFKC", password).encode(), salt=base64.b64decode(salt), n=int(n), r=int(r), p=int(p), dklen=len(expected), maxmem=64 << 20)
    except (ValueError, TypeError):
        return False
    return hmac.compare_digest(found, expected)


@dataclass(frozen=True)
class Caller:
    user_id: str
    role: str
    merchant_id: str | None


class InvalidToken(ValueError):
    pass


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def issue_access_token(caller: Caller, secret: str, now: datetime, seconds: int) -> str:
    at = int(now.timestamp())
    claims = {"role": caller.role, "mid": caller.merchant_id, "sub": caller.user_id, "iss": ISSUER, "aud": ISSUER, "iat": at, "exp": at + seconds}
    body = ".".join(_b64(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, claims))
    return f"{body}.{_b64(hmac.digest(secret.encode(), body.encode(), 'sha256'))}"


def verify_access_token(token: str, secret: str, now: datetime) -> Caller:
    """Only HS256 counts, whatever the token's header asks for."""
    try:
        head, body, mark = token.split(".")
        if json.loads(_unb64(head)).get("alg") != "HS256":
            raise InvalidToken("the algorithm is not HS256")
        if not hmac.compare_digest(hmac.digest(secret.encode(), f"{head}.{body}".encode(), "sha256"), _unb64(mark)):
            raise InvalidToken("the signature is wrong")
        claims = json.loads(_unb64(body))
    except InvalidToken:
        raise
    except Exception as e:
        raise InvalidToken("not a token") from e
    if claims.get("iss") != ISSUER or claims.get("aud") != ISSUER:
        raise InvalidToken("issued by or for someone else")
    if not isinstance(claims.get("exp"), int) or claims["exp"] <= now.timestamp():
        raise InvalidToken("expired")
    if claims.get("role") not in ROLES:
        raise InvalidToken("unknown role")
    if not isinstance(claims.get("mid"), str | None) or not isinstance(claims.get("sub"), str):
        raise InvalidToken("claims are missing")
    return Caller(claims["sub"], claims["role"], claims["mid"])


# rules between tenants


def merchant_for_write(caller: Caller, requested: str | None) -> str:
    if caller.role == "platform_staff":
        if requested is None:
            raise ApiError(400, "bad_request", "staff must name the merchant")
        return requested
    if requested is not None and requested != caller.merchant_id:
        raise ApiError(403, "forbidden", "that is another merchant")
    return caller.merchant_id


def merchant_for_read(caller: Caller, requested: str | None) -> str | None:
    """None: all merchants."""
    if caller.role == "platform_staff":
        return requested
    if requested is not None and requested != caller.merchant_id:
        raise ApiError(403, "forbidden", "that is another merchant")
    return caller.merchant_id


def check_row(caller: Caller, merchant_id: str) -> None:
    """Another tenant's rows look as if they weren't there."""
    if caller.role != "platform_staff" and caller.merchant_id != merchant_id:
        raise ApiError(404, "not_found", "not found")


def require_staff(caller: Caller) -> None:
    if caller.role != "platform_staff":
        raise ApiError(403, "forbidden", "staff only")


def slug_of(name: str) -> str:
    """The same rule as functions.text.slugify, for one name."""
    return re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")[:48] or "merchant"


class Accounts:
    def __init__(self, store: Store, config: Config, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.store, self.config, self.clock = store, config.checked(), clock
        self._dummy = hash_password(secrets.token_hex(16))

    def _commit(self, make: Callable[[], dict]) -> None:
        """Commit records that `make` builds from the newest state; again if another commit came first."""
        while True:
            expect = self.store.version()
            try:
                self.store.commit(make(), expect=expect)
                return
            except Conflict:
                continue

    def _session(self, user: dict) -> dict:
        caller = Caller(user["id"], user["role"], user["merchant_id"])
        now = self.clock()
        access = issue_access_token(caller, self.config.token_secret, now, self.config.access_token_seconds)
        refresh = _b64(secrets.token_bytes(48))
        expires = now + timedelta(seconds=self.config.refresh_token_seconds)
        record = {"id": str(uuid.uuid4()), "user_id": user["id"], "token_hash": hashlib.sha256(refresh.encode()).hexdigest(), "expires_at": now_text(expires), "revoked_at": None, "created_at": now_text(now)}
        return {"tokens": {"accessToken": access, "refreshToken": refresh, "expiresIn": self.config.access_token_seconds}, "record": record}

    def register(self, email: str, password: str, *, merchant_name: str | None = None, staff_code: str | None = None) -> dict:
        if not EMAIL.fullmatch(email):
            raise ApiError(400, "validation_failed", "not an email address")
        if not 12 <= len(password) <= 256:
            raise ApiError(400, "validation_failed", "a password has 12 to 256 characters")
        if (merchant_name is None) == (staff_code is None):
            raise ApiError(400, "validation_failed", "give a merchant name or a staff code")
        if merchant_name is not None and not 2 <= len(merchant_name) <= 120:
            raise ApiError(400, "validation_failed", "the merchant name needs 2 to 120 characters")
        if staff_code is not None and not hmac.compare_digest(staff_code.encode(), self.config.staff_code.encode()):
            raise ApiError(403, "forbidden", "the staff code is wrong")
        hashed, made = hash_password(password), {}

        def make() -> dict:
            if any(u["email"].lower() == email.lower() for u in self.store.records("users").values()):
                raise ApiError(409, "conflict", "that email address is registered")
            now, changes = now_text(self.clock()), {}
            merchant = None
            if merchant_name is not None:
                slugs = {m["slug"] for m in self.store.records("merchants").values()}
                base = slug_of(merchant_name)
                free = next((s for s in (base, *(f"{base}-{secrets.token_hex(3)}" for _ in range(4))) if s not in slugs), None)
                if free is None:
                    raise ApiError(409, "conflict", "no free name for that merchant")
                merchant = {"id": str(uuid.uuid4()), "name": merchant_name, "slug": free, "created_at": now}
                changes["merchants"] = {merchant["id"]: merchant}
            user = {"id": str(uuid.uuid4()), "email": email, "password_hash": hashed, "role": "platform_staff" if merchant is None else "merchant_user", "merchant_id": merchant and merchant["id"], "created_at": now}
            session = self._session(user)
            made.update(user=user, tokens=session["tokens"])
            return changes | {"users": {user["id"]: user}, "refresh_tokens": {session["record"]["id"]: session["record"]}}

        self._commit(make)
        return {"user": self._shown(made["user"]), **made["tokens"]}

    def _shown(self, user: dict) -> dict:
        return {"id": user["id"], "email": user["email"], "role": user["role"], "merchantId": user["merchant_id"]}

    def login(self, email: str, password: str) -> dict:
        user = next((u for u in self.store.records("users").values() if u["email"].lower() == email.lower()), None)
        good = verify_password(password, user["password_hash"] if user else self._dummy)  # as long for unknown users
        if not user or not good:
            raise ApiError(401, "unauthorized", "no account has that address and password")
        session = self._session(user)
        self._commit(lambda: {"refresh_tokens": {session["record"]["id"]: session["record"]}})
        return {"user": self._shown(user), **session["tokens"]}

    def _live(self, token: str) -> dict | None:
        digest = hashlib.sha256(token.encode()).hexdigest()
        found = next((t for t in self.store.records("refresh_tokens").values() if t["token_hash"] == digest), None)
        return found if found and found["revoked_at"] is None and datetime.fromisoformat(found["expires_at"]) > self.clock() else None

    def refresh(self, token: str) -> dict:
        """Use up a refresh token and issue the next, in one commit."""
        made = {}

        def make() -> dict:
            old = self._live(token)
            user = old and self.store.records("users").get(old["user_id"])
            if not user:
                raise ApiError(401, "unauthorized", "that refresh token can't be used (any more)")
            session = self._session(user)
            made.update(session["tokens"])
            return {"refresh_tokens": {old["id"]: old | {"revoked_at": now_text(self.clock())}, session["record"]["id"]: session["record"]}}

        self._commit(make)
        return made

    def logout(self, token: str) -> None:
        def make() -> dict:
            old = self._live(token)
            return {"refresh_tokens": {old["id"]: old | {"revoked_at": now_text(self.clock())}}} if old else {}

        self._commit(make)

    def revoke_all(self, user_id: str) -> None:
        def make() -> dict:
            now = now_text(self.clock())
            return {"refresh_tokens": {t["id"]: t | {"revoked_at": now} for t in self.store.records("refresh_tokens").values() if t["user_id"] == user_id and t["revoked_at"] is None}}

        self._commit(make)

    def authenticate(self, header: str | None) -> Caller:
        if not header or not header.startswith("Bearer "):
            raise ApiError(401, "unauthorized", "send an access token as Bearer")
        try:
            return verify_access_token(header.removeprefix("Bearer "), self.config.token_secret, self.clock())
        except InvalidToken as e:
            raise ApiError(401, "unauthorized", "that access token doesn't hold (any more)") from e

    def me(self, caller: Caller) -> dict:
        user = self.store.records("users").get(caller.user_id)
        if not user:
            raise ApiError(404, "not_found", "not found")
        merchant = self.store.records("merchants").get(user["merchant_id"] or "")
        return self._shown(user) | {"merchant": merchant and {k: merchant[k] for k in ("id", "name", "slug")}}
