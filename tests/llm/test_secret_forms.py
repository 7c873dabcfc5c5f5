"""Secrets in their shortest forms, in other alphabets and wrappings: what the parsers confirm is found in every encoding."""

import base64
import json

import pytest

from quillmark.llm.secret_scan import is_der_key, is_signed_token, is_ssh_key, scan


def der(tag, *parts):
    body = b"".join(parts)
    return bytes([tag, len(body)]) + body


def sec1(n):
    return der(0x30, der(2, b"\x01"), der(4, bytes(range(7, 7 + n))))


def field(data):
    return len(data).to_bytes(4, "big") + data


KEYS = {
    "sec1_20": sec1(20),
    "sec1_24": sec1(24),
    "sec1_32": sec1(32),
    "pkcs8": der(0x30, der(2), der(0x30, der(6)), der(4, b"k" * 16)),
    "encrypted": der(0x30, der(0x30, der(6)), der(4, b"q" * 16)),
    "pkcs1": der(0x30, der(2, b"\0"), der(2, b"n" * 32), *[der(2)] * 7),
}
SSH = b"openssh-key-v1\x00" + field(b"") * 3 + (1).to_bytes(4, "big") + field(b"") + field(b"k")


def unpadded(raw):
    return base64.b64encode(raw).decode().rstrip("=")


@pytest.mark.parametrize("name", KEYS)
def test_shortest_keys(name):
    key = KEYS[name]
    assert is_der_key(key)
    for text in (base64.b64encode(key).decode(), unpadded(key), base64.urlsafe_b64encode(key).decode()):
        assert ("der", 4, 4 + len(text)) in scan(f"key {text} end")
    for text in (key.hex(), key.hex().upper()):
        assert ("der", 4, 4 + len(text)) in scan(f"key {text} end")
    assert not [s for s in scan(f"key {key.hex()[:-2]} end") if s[0] == "der"]


def test_openssh_keys():
    assert is_ssh_key(SSH) and len(SSH) == 40
    for text in (base64.b64encode(SSH).decode(), unpadded(SSH), SSH.hex(), SSH.hex().upper()):
        assert ("ssh", 2, 2 + len(text)) in scan(f"x {text}")


@pytest.mark.parametrize("body", ['{"user":"Jörg","password":"hunter2hunter2"}', "пароль token=abcdefgh", "密码 AKIA" + "Q" * 16, "token=abcdefgh", "\ttoken: abcdefgh\r\n"])
def test_decoded_text_is_utf8(body):
    for text in (unpadded(body.encode()), body.encode().hex()):
        assert ("enc", 1, 1 + len(text)) in scan(f"[{text}]")


@pytest.mark.parametrize("raw", ["token=abcdefgh".encode() + b"\xff", "token=abcdefgh\x00".encode(), "token=abcdefgh".encode("utf-16")])
def test_other_bytes_are_no_text(raw):
    assert not [s for s in scan(unpadded(raw)) if s[0] == "enc"]


@pytest.mark.parametrize("width", [4, 7, 12, 16, 64])
def test_wrapped(width):
    text = unpadded('{"user":"Jörg","password":"hunter2hunter2","more":"words to fill a line or two"}'.encode())
    lines = "\n".join(text[i : i + width] for i in range(0, len(text), width))
    found = [s for s in scan(f"-\n{lines}\n.") if s[0] == "enc"]
    assert ("enc", 2, 2 + len(lines)) in found
    assert not scan("\n".join("only words here that happen to be the same long ones".split()))


def test_signed_tokens():
    def part(x):
        return base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")

    for head in ('{"alg":"none"}', '{"alg":"x"}', ' {"alg":"HS256"}', '{\n"alg": "RS256", "typ": "JWT"}'):
        token = f"{part(head)}.{part('{}')}.{base64.urlsafe_b64encode(b's' * 16).decode().rstrip('=')}"
        assert is_signed_token(token) and ("jwt", 1, 1 + len(token)) in scan(f"({token})")
    assert not scan("www-documentation.example.com and some.dotted.words-here")
    assert not scan(f"{part(json.dumps({'typ': 'JWT', 'kid': 1}))}.{part('{}')}.abc")
