"""Labelled findings made by planting: secrets and values that only look like them, put between words of the corpus.

What a planted value is, is known because it was put there; no label is read off the features that
the forest sees. Everything follows from the seed.
"""

from __future__ import annotations

import random
import string
import uuid

ALNUM, HEX = string.ascii_letters + string.digits, "0123456789abcdef"
# Names that secrets are assigned to, names that are not, and stand-ins that people write for a secret.
SECRET_NAMES = ["token", "secret", "password", "passwd", "pwd", "api_key", "apiKey", "API-KEY", "access_key", "private_key", "DB_PASSWORD", "GITHUB_TOKEN", "STRIPE_API_KEY", "aws_secret_access_key", "accessToken", "client_secret", "sshKey", "auth", "authKey", "credential", "passphrase"]
OTHER_NAMES = ["commit", "sha256", "digest", "etag", "id", "request_id", "trace", "isbn", "order", "version", "path", "file", "url", "build", "public_key", "monkey", "primary_key", "session", "checksum", "invoice", "serial"]
STAND_INS = ["changeme", "********", "xxxxxxxxxxxx", "your-token-here", "<your-secret>", "${API_TOKEN}", "{{password}}", "placeholder", "required", "undefined", "redacted", "$(get_secret)", "password", "YOUR_API_KEY", "os.environ", "process.env.TOKEN", "example_token", "not_a_secret", "<SECRET>", "(optional)"]
# Parts of values that people write to show where a secret goes, and endings of the sample keys in manuals.
SCHEMES = ["https", "http", "postgres", "ftp", "mongodb"]
SHOWN = ["change", "example", "sample", "dummy", "your", "here", "todo", "replace", "insert", "enter", "default", "secret", "token", "password", "none", "null", "test", "fake", "redacted", "value"]
JOINS = [("=", ""), (" = ", ""), (": ", ""), (":", ""), ('="', '"'), (' = "', '"'), (" = '", "';"), ('": "', '"'), ("' => '", "'"), ("' : '", "',"), (" := ", "")]


def examples(n: int, seed: int) -> list[tuple[str, str, str, float]]:
    """n times (what stands before, value, what stands after, label 1 for a secret)."""
    rng = random.Random(seed)
    take = lambda letters, a, b: "".join(rng.choices(letters, k=rng.randint(a, b)))
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    strong = [lambda: take(HEX, 16, 64), lambda: take(ALNUM, 12, 48), lambda: take(ALNUM + "+/", 24, 44), lambda: take(ALNUM + "_-", 16, 40), lambda: take(ALNUM + "!@#%^&*", 9, 20), lambda: take(ALNUM + "+/", 20, 40) + "==", lambda: word().title() + take(string.digits, 4, 10), lambda: take(string.ascii_letters, 16, 40), lambda: take(ALNUM + "/", 18, 30) + rng.choice(SHOWN).upper() + take(string.ascii_letters, 4, 9)]  # the last: a word within a long key is no proof of a stand-in
    known = [
        lambda: "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)),
        lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + take(ALNUM, 36, 36),
        lambda: rng.choice(["sk_live_", "rk_live_", "sk_test_"]) + take(ALNUM, 20, 28),
        lambda: rng.choice(["sk_live_", "sk_test_"]) + take(string.ascii_letters, 16, 24),
        lambda: rng.choice(["ghp_", "glpat-", "rk_live_"]) + take(string.ascii_letters, 30, 36),
        lambda: "glpat-" + take(ALNUM, 20, 24),
        lambda: "xoxb-" + take(string.digits, 11, 12) + "-" + take(ALNUM, 20, 26),
        lambda: "AIza" + take(ALNUM + "_-", 35, 35),
        lambda: f"eyJ{take(ALNUM, 15, 30)}.eyJ{take(ALNUM, 20, 40)}.{take(ALNUM + '_-', 30, 45)}",
    ]
    plain = [
        lambda: take(string.digits, 16, 20),
        lambda: take(HEX, 40, 40),
        lambda: take(HEX, 64, 64),
        lambda: take(HEX, 32, 32),
        lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 99)),
        lambda: "_".join(word() for _ in range(rng.randint(3, 5))) + str(rng.randint(1, 99)),
        lambda: "".join(word().title() for _ in range(rng.randint(3, 5))) + str(rng.randint(1, 999)),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word()}-{word()}",
        lambda: word() + take(string.digits, 5, 9),
        lambda: rng.choice(["sha1-", "sha384-", "md5-"]) + take(ALNUM + "+/", 27, 64) + rng.choice(["", "=", "=="]),
    ]
    shown = lambda: rng.choice(["", "<", "$", "%"]) + rng.choice("-_ .").replace(" ", "").join(rng.choice(SHOWN) for _ in range(rng.randint(2, 4))) + rng.choice(["", "123", "1", ">", "}"])
    sample = [  # keys of a known form that open nothing
        lambda: "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=9)) + "EXAMPLE",
        lambda: rng.choice(["ghp_", "sk_test_", "sk_live_", "AIza", "glpat-"]) + rng.choice("xX0*aA1") * rng.randint(30, 36),
        lambda: "AKIA" + rng.choice("XA01") * 16,
        lambda: rng.choice(["sk_test_", "sk_live_", "ghp_", "hf_"]) + "".join(rng.choice(SHOWN) for _ in range(8))[:36],
    ]
    out = []
    for _ in range(n):
        (join, end), kind = rng.choice(JOINS), rng.random()
        quote = "'" if join.startswith("'") else '"' if join.startswith('"') else ""
        if kind < 0.38:
            out.append((quote + rng.choice(["", "", "my_", "export ", "APP_"]) + rng.choice(SECRET_NAMES) + join, rng.choice(strong)(), end, 1.0))
        elif kind < 0.43:
            out.append((f"{rng.choice(SCHEMES)}://{word()}:", rng.choice(strong[1:2] + strong[4:5] + strong[6:8])().replace("@", "").replace("/", ""), f"@{word()}.{word()}{rng.choice(['', ':5432', '/' + word()])}", 1.0))
        elif kind < 0.46:
            out.append((f"{rng.choice(SCHEMES)}://{word()}:", rng.choice([*STAND_INS[:3], "password", shown().replace("@", "")]), f"@{rng.choice(['localhost', 'host', word() + '.' + word()])}", 0.0))
        elif kind < 0.56:
            lead, tail = rng.choice([("use ", " "), ("", ""), ("key ", " "), ("(", ")"), ('"', '"')])
            out.append((lead, rng.choice(known)(), tail, 1.0))
        elif kind < 0.59:
            lead, tail = rng.choice([("use ", " "), ("", ""), ("key ", " "), ("(", ")"), ('"', '"')])
            out.append((lead, rng.choice(sample)(), tail, 0.0))
        elif kind < 0.62:
            out.append((quote + rng.choice(SECRET_NAMES) + join, rng.choice(sample)(), end, 0.0))
        elif kind < 0.69:
            out.append((quote + rng.choice(SECRET_NAMES) + join, rng.choice(STAND_INS) if rng.random() < 0.5 else shown(), end, 0.0))
        elif kind < 0.84:
            out.append((quote + rng.choice(OTHER_NAMES) + join, rng.choice(plain)(), end, 0.0))
        else:
            out.append((rng.choice(["", "", "paid ", "commit ", "see ", "no. ", "sha256:", "at "]), rng.choice(plain)(), rng.choice(["", ".", ",", " "]), 0.0))
    return out


def others(n: int, seed: int) -> list[tuple[str, str, str, float]]:
    """As `examples`, by another generator: its names, stand-ins, schemes, known forms and checksums are none of those, so what is fitted on the one can be tried on the other (both are by one hand)."""
    rng = random.Random(seed)
    take = lambda letters, k: "".join(rng.choices(letters, k=k))
    names = ["SMTP_PASSWORD", "jwt_secret", "redisPassword", "slack_token", "twilio-auth-token", "session_secret", "mysql_pwd", "webhookSecret", "vault_token", "root_password"]
    found = [
        lambda: (rng.choice(names) + rng.choice(["=", ": ", '="']), take(ALNUM, rng.randint(14, 40)), rng.choice(["", " ", "\n"])),
        lambda: (rng.choice(names) + rng.choice(["=", ": "]), take(ALNUM, rng.randint(4, 6)) + rng.choice("!#%&*") + take(ALNUM, rng.randint(5, 9)), "\n"),
        lambda: (f"{rng.choice(['mysql', 'amqp', 'redis', 'smtp'])}://{rng.choice(['root', 'admin', 'app_user'])}:", take(ALNUM, rng.randint(10, 22)), f"@{rng.choice(['10.0.0.5', 'db.internal'])}:3306/app"),
        lambda: ("", rng.choice(["hf_", "gho_", "npm_"]) + take(ALNUM, 36), " "),
        lambda: ("export KEY_ID=", "ASIA" + take(string.ascii_uppercase + string.digits, 16), "\n"),
    ]
    lookalike = [
        lambda: (rng.choice(names) + rng.choice(["=", ": "]), rng.choice(["changeme123", "TODO-set-me", "fill_me_in", "replace-this-later", "dummyvalue1", "insert-token-here", "notarealpassword", "example-password", "<put-it-here>", "$SECRET_FROM_ENV", "{{vault.token}}", "xxxx-xxxx-xxxx"]), "\n"),
        lambda: (f"{rng.choice(['mysql', 'amqp', 'redis'])}://user:", rng.choice(["yourpassword", "<password>", "changeit", "$DB_PASS", "*******", "example"]), "@localhost/app"),
        lambda: ('integrity="', rng.choice(["sha256-", "sha512-"]) + take(ALNUM + "+/", rng.choice([43, 86])) + "=", '"'),
        lambda: ("ETag: ", take(HEX, 32), "\n"),
        lambda: ("at revision ", take(HEX, 40), "."),
        lambda: ("see docs/", "/".join(rng.choice(["guide", "setup", "auth", "install", "page"]) for _ in range(5)) + str(rng.randint(1, 9)), " "),
        lambda: ("use ", rng.choice(["ASIA" + take(string.ascii_uppercase + string.digits, 9) + "EXAMPLE", "hf_" + "x" * 34, "npm_" + "0" * 36, "gho_" + "A" * 36]), " here"),
        lambda: ("tracking ", take(string.digits, rng.randint(16, 22)), ","),
    ]
    made = lambda kinds, label: (*rng.choice(kinds)(), label)
    return [made(found, 1.0) if rng.random() < 0.5 else made(lookalike, 0.0) for _ in range(n)]
