import hashlib
import random
import time

from siltstone.llm import secrets

KEY = "Zx81kLmP0qRs"


def lex(text):
    return [text[a:b] for a, k, b in secrets.find_secrets(text) if k == 3]


def test_base_spans():
    text = f'é password = "abcdef" Token:x api_key=12345 AKIA{"A" * 15} AKIA{"B" * 16}c {"0a" * 12} API-KEY=aaaaaa apiKey\' : \'q/w.e+r=t'
    got = [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.find_secrets(text) if k < 3]
    assert got == [
        ("assign", 'password = "abcdef'), ("access", "AKIA" + "B" * 16), ("hex", "0a" * 12), ("assign", "apiKey' : 'q/w.e+r=t"),
    ]
    assert secrets.find_secrets("paſſword=abcdefg toKen=abcdefg") == []
    assert secrets.find_secrets("") == [] and secrets.find_secrets("x=" * 20000) == []


def test_lexing_and_constants():
    assert lex(f'db_pwd := "{KEY}"') == [KEY] and lex(f'{{"auth_credential": "{KEY}"}}') == [KEY]
    assert lex(f"A = '{KEY}'\nB = A\nconfig.passphrase = B") == [KEY]
    assert lex("part = 'Zx81kL'\nsigning_private_key = part + 'mP0qRs'") == ["Zx81kL", "mP0qRs"]
    assert lex(f"colour = '{KEY}'") == [] and lex("pwd = 'your-password-1'") == [] and lex("the key: value of it") == []
    assert lex(f"password = {KEY}") == []  # the base span covers it


def test_lexing_drops_nothing_by_size_blanks_lines_or_types():
    long = KEY * 900
    assert lex(f"db_pwd := '{long}'") == [long]
    pieces = [f"{KEY}{n:03d}" for n in range(90)]
    assert lex("db_pwd := " + " + ".join(f"'{x}'" for x in pieces)) == pieces
    assert lex("db_pwd := " + " +\n   ".join(f"'{x}'" for x in pieces)) == pieces
    assert lex("db_pwd := " + "\n   + ".join(f"'{x}'" for x in pieces)) == pieces
    assert lex(f"db_pwd := '{KEY}' + \\\n '{KEY}x'") == [KEY, KEY + "x"]
    assert lex(f"db_pwd := '{KEY}'\n+colour = 'blue-{KEY}'") == [KEY]
    assert lex("db_pwd := 'correct Horse battery staple'") == ["correct Horse battery staple"]
    assert lex("sort_key := 'Some plain Title text'") == []
    pem = "-----BEGIN KEY----- MIIEvQIBADANBgkqhkiG9w0 -----END KEY-----"
    assert lex(f'"key": "{pem}"') == [pem]
    for head in ("clientCredential: string", "let credential: &'static str", "val credential: String?", "credential: str | None", "credential: Optional[str]", "var credential string"):
        assert lex(f'{head} = "{KEY}"') == [KEY]
    assert lex(f'colour: string = "{KEY}"') == []
    # constants that double or grow on each line stay in proportion
    assert lex("a = 'Zx81kLmP'\n" + "a = a + a\n" * 3000 + "db_pwd := a") == ["Zx81kLmP"]
    assert len(lex("pwd = 'Zx81kLmP'\n" + f"pwd = pwd + '{KEY}'\n" * 3000)) == 3001


def test_lexing_of_strings_calls_brackets_and_tags():
    assert lex(f'db_pwd := """{KEY}"""') == lex(f"db_pwd := \'\'\'{KEY}\'\'\'") == lex(f"db_pwd := `{KEY}`") == [KEY]
    assert lex(f"passphrase = r'{KEY}'") == [KEY] and lex(f"passphrase = f('{KEY}')") == [KEY]
    assert lex(f"passphrase = decode(wrap(b'{KEY}'), 'utf-8')") == [KEY]
    assert lex("passphrase = os.getenv('MY_SECRET_KEY')") == [] and lex("passphrase = ask('Enter the word: ')") == []
    assert lex(f"def open_db(user, passphrase='{KEY}', n=3):") == [KEY] and lex(f"connect(passphrase: '{KEY}')") == [KEY]
    assert lex(f"<db><passphrase>{KEY}</passphrase></db>") == [KEY] and lex(f"<key>passphrase</key>\n <string>{KEY}</string>") == [KEY]
    assert lex(f"<colour>{KEY}</colour>") == []
    assert lex(f"passphrase = (\n    '{KEY}'\n    'x{KEY}'\n)") == [KEY, "x" + KEY]
    assert lex(f"passphrase = (  # long\n  '{KEY}' +\n  'x{KEY}'\n)\ncolour = 'z{KEY}'") == [KEY, "x" + KEY]
    assert lex(f"config['passphrase'] = '{KEY}'") == lex(f"$cfg = array('passphrase' => '{KEY}');") == [KEY]
    assert lex(f'{{"db": {{"passphrase": "{KEY}", "colour": "y{KEY}"}}}}') == [KEY]
    assert lex(f"db:\n  passphrase: |\n    {KEY}\n    {KEY}\n  colour: x") == [f"{KEY}\n    {KEY}"]
    assert lex(f"passphrase: {KEY}\ncolour: y{KEY}") == [KEY] and lex(f"export DB_PWD={KEY}") == [KEY]
    assert lex(f"""run = "export PASSPHRASE='{KEY}' && go" """) == [KEY]
    assert lex(f"don't say passphrase = '{KEY}' or it isn't one") == [KEY]
    assert lex(f"a = passphrase = '{KEY}'") == [KEY] and lex(f"passphrase = test ? '{KEY}' : 'y{KEY}'") == [KEY, "y" + KEY]


def test_comparisons_and_comments_assign_nothing():
    for text in ("if passphrase == '{}':", "passphrase != '{}'", "# passphrase = '{}'", "// passphrase = '{}'", "/* passphrase =\n '{}' */",
                 "<!-- passphrase = '{}' -->", "same = passphrase === '{}'", "if passphrase: colour = '{}'", "-- passphrase = '{}'", "  ; passphrase = '{}'"):
        assert lex(text.format(KEY)) == [], text
    assert lex(f"see http://h.org/x passphrase = '{KEY}'") == [KEY]


def test_constants_last_until_they_are_assigned_something_else():
    assert lex(f"A = '{KEY}'\nA = load()\npassphrase = A") == [] and lex(f"A = '{KEY}'\nA = 'x{KEY}'\npassphrase = A") == ["x" + KEY]
    assert lex(f"A = '{KEY}'\nA += 'x{KEY}'\npassphrase = A") == [KEY, "x" + KEY]


def test_lexing_has_no_bounds_and_is_linear():
    assert lex(f"passphrase{'_x' * 5000} = '{KEY}'") == [KEY] and lex(f"passphrase{' ' * 5000}= '{KEY}'") == [KEY]
    began = time.perf_counter()
    n = 100_000
    for text in ("a:" * n, "a: b = " * n, "key = '" + "\\'" * n, "\"\\" * n, "(" * n + "key=", "key: |\n" * n, "f(key=" * n, "x = a ? b : " * n, "key=a " * n,
                 "key= /*" * n, "<key " * n, "<key>" * n, "key = \'\'\'" * n, "key: a " * n, "key = {" * n, "key\t" + "'a':" * n, "key = " + "`" * n):
        secrets.find_secrets(text)
    assert time.perf_counter() - began < 60


def brute_base(text):
    """Base spans by trying every start and the longest end, without regular expressions."""
    def starts(i, word):
        return len(text) >= i + len(word) and all(c == w or c.isascii() and c.lower() == w for c, w in zip(text[i:], word))

    def run(i, allowed):
        while i < len(text) and text[i] in allowed:
            i += 1
        return i

    letters = "abcdefghijklmnopqrstuvwxyz"
    value = set(letters + letters.upper() + "0123456789+/_.=-")

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if starts(i, word):
                for quoted in (1, 0):
                    at = i + len(word)
                    if quoted and text[at : at + 1] not in ("'", '"') or not text[at : at + 1]:
                        continue
                    at = run(at + quoted, " ")
                    if text[at : at + 1] in (":", "="):
                        at = run(at + 1, " ")
                        at += text[at : at + 1] in ("'", '"') and text[at : at + 1] != ""
                        end = run(at, value)
                        if end > at:
                            return end, end - at >= 6
        return None

    def access(i):
        end = run(i + 4, set(letters.upper() + "0123456789")) if text[i : i + 4] == "AKIA" else i
        return (end, end - i >= 20) if end > i + 4 else None

    def hexa(i):
        end = run(i, set("0123456789abcdef"))
        return (end, end - i >= 24) if end > i else None

    out = []
    for kind, match in enumerate((assign, access, hexa)):
        i = 0
        while i < len(text):
            hit = match(i)
            if hit and hit[1]:
                out.append((i, kind, hit[0]))
            i = hit[0] if hit else i + 1
    return sorted(out)


def test_base_spans_match_brute_force():
    rng = random.Random(3)
    bits = ["password", "PassWD", "secret", "ToKen", "api_key", "apikey", "api-key", "'", '"', " ", "  ", ":", "=", "AKIA", "A" * 15, "0123456789abcdef", "ab",
            "é", "\n", "x1/+_.=-", "ſ", "K", "deadbeef" * 3, "Z"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [x for x in secrets.find_secrets(text) if x[1] < 3] == brute_base(text), text


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "secret: hunter22"), (3, "secret: hunter22"), (None, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = secrets.scan_secrets(df).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_assign, r.spans) for r in got] == [(1, 0, ""), (2, 0, ""), (3, 1, "assign:0:16"), (3, 1, "assign:0:16"), (None, 0, "")]
    assert got[0].base_sha256 == none and got[2].base_sha256 == hashlib.sha256(b"assign:0:16").hexdigest()
    assert secrets.scan_secrets(df.limit(0)).count() == 0
