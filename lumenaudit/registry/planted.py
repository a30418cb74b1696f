"""Views that plant known content on every row of the given tables.

The tables alone exercise few detectors, so these views add content that
depends on the key.  No row is left out: a CASE chooses what a row gets, never
whether it stays.  The SQL runs unchanged on Spark and on the comparison engine
apart from the name of the byte-length function.  Look-alike credentials are
put together at run time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"


def _json(text: str) -> str:
    """A JSON text as a SQL literal without braces, which the view formatter would read."""
    return "'" + text.replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '") + "'"


def _shapes(key: str) -> str:
    """One credential shape per ``key % 29``, in detector order."""
    h = f"md5(cast({key} as string))"

    def cut(n):
        return f"substring({h}, 1, {n})"

    shapes = [
        f"""'api_key = "' || {cut(24)} || '"'""",
        f"""'client-secret: "' || {cut(28)} || '"'""",
        f"""'APIKEY=' || {cut(20)}""",
        f"""'use sk_' || 'live_' || {cut(24)}""",
        f"""'id AK' || 'IA' || upper({cut(16)})""",
        f"""'ya' || '29.' || {h}""",
        f"""'AI' || 'za' || {h} || 'abc'""",
        f"""'gh' || 'u_' || {h} || {cut(8)}""",
        f"""'git' || 'hub_pat_' || {h} || {h}""",
        f"""'xo' || 'xb-' || {h}""",
        f"""'S' || 'G.' || {cut(20)} || '.' || {h}""",
        f"""'"token": "' || {h} || '"'""",
        f"""'refresh_token = "' || {h} || '"'""",
        f"""'auth-token=' || {h}""",
        f"""'ey' || 'J' || {h} || '.' || {h} || '.' || {h}""",
        f"""'password = "' || {cut(10)} || '"'""",
        f"""'db_password: "' || {cut(11)} || '"'""",
        f"""'passphrase="' || {cut(12)} || '"'""",
        f"""'PASSWD=' || {cut(12)}""",
        f"""'db-url = "host/' || {cut(6)} || '"'""",
        f"""'redis' || '://' || {cut(12)} || '.internal/0'""",
        """'-----BEGIN RSA ' || 'PRIVATE KEY-----'""",
        f"""'write to u' || {cut(8)} || '@corp' || cast({key} % 7 as string) || '.test now'""",
        f"""'host 10.' || cast({key} % 250 as string) || '.3.4 up'""",
        f"""'host 192.168.' || cast({key} % 250 as string) || '.9 up'""",
        f"""'host 172.20.' || cast({key} % 250 as string) || '.7 up'""",
        f"""'config = "app/' || {cut(5)} || '.yml"'""",
        f"""'stripe_secret = "' || {cut(24)} || '"'""",
        f"""'rk' || '_test_' || {cut(20)}""",
    ]
    return f"CASE {key} % 29 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes)) + " END"


def _decoys(key: str) -> str:
    return (
        f"CASE {key} % 31 WHEN 0 THEN 'password = \"changeme\"' WHEN 1 THEN 'api_key = \"your_key_goes_here\"' "
        f"WHEN 2 THEN 'token = \"' || repeat('a', 20) || '\"' WHEN 3 THEN 'pwd: \"abc\"' "
        f"WHEN 4 THEN 'api_key = \"abababababab\"' WHEN 5 THEN 'see logo@2x.png' "
        f"WHEN 6 THEN 'api_key = \"' || substring(md5('shared'), 1, 20) || '\"' ELSE '' END"
    )


_SHAPE, _DECOY = _shapes("doc_id"), _decoys("doc_id")
_CSHAPE = _shapes("conv_id * 7 + turn")
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_HEX = "substring(md5(target), 1, 1)"
_PAGE_MD5 = "md5(cast(page_id as string))"


def _pick(key: str, values: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def _head(*lines: str) -> str:
    return f" || {_NL} || ".join(lines)


_RAW_HEADERS = _pick("page_id % 10", {
    0: "''",
    1: _head("'Strict-Transport-Security: max-age=1'", "'Content-Security-Policy: default-src'",
             "'X-Frame-Options: DENY'", "'X-Content-Type-Options: nosniff'", "'Referrer-Policy: no-referrer'",
             "'Permissions-Policy: camera=()'"),
    2: _head("'content-security-policy: frame-ancestors none'", "'Server: nginx/1.18.' || cast(page_id % 4 as string)"),
    3: _head("'X-Content-Type-Options: Sniffy'", "'X-Powered-By: PHP/8.1.2'", "'Referrer-Policy: origin'"),
    4: _head("'Server: Apache/2.4.1 (Unix)'", f"'Set-Cookie: sid=' || {_PAGE_MD5} || '; Path=/; HttpOnly'",
             f"'Set-Cookie: laravel_session=' || {_PAGE_MD5} || '; Secure; SameSite=Lax'"),
    5: _head("'Server: cloudflare'", f"'CF-RAY: ' || {_PAGE_MD5}"),
    6: _head("'X-Iinfo: 1-2'", f"'Set-Cookie: incap_ses_1=' || {_PAGE_MD5}", "'set-cookie: visid_incap=2; HttpOnly'"),
    7: _head("'SERVER: Microsoft-IIS/10.0'", "'X-Powered-By: ASP.NET'", "'x-content-type-options: NOSNIFF'"),
    8: _head("'Server: plain'", "'X-Powered-By: Express'", "'Set-Cookie: csrftoken=1; Secure; HttpOnly; SameSite=Strict'"),
}, "'Set-Cookie: flagless'")

_BODY = "html || " + _pick("page_id % 7", {
    0: """'<script src="http://cdn' || cast(page_id % 3 as string) || '.other.test/a.js"></script>'""",
    1: """'<link rel="x" href="https://cdn.other.test/b.css" integrity="sha384-x">' || '<script src="https://cdn.other.test/c.js"></script>' || '<SCRIPT SRC="https://cdn.other.test/c.js"></SCRIPT>'""",
    2: """'<meta name="generator" content="Builder ' || cast(page_id % 5 as string) || '">' || '<p>/wp-content/x</p>'""",
    3: """'<title>Index of /files</title><a href="../">Parent Directory</a>'""",
    4: """'<div data-reactroot></div><script src="/_next/static/x.js"></script>'""",
    5: """'"backup/db.sql" (conf/app.yml) "note.txt" "old/wp-config.PHP.Bak" "backup/db.sql" ' || 'Drupal.settings'""",
}, "'<p>nothing</p>'")

_FILE_NAME = _pick("page_id % 14", {
    0: "'.env'", 1: "'dump.sql'", 2: "'a.env.production'", 3: "'id_rsa'", 4: "'wp-config.php'", 5: "'error.log'",
    6: "'cfg.yml'", 7: "'config.json'", 8: "'.git/HEAD'", 9: "'.DS_Store'", 10: "'site.pem'", 11: "'web.config'",
    12: "'Settings.PHP'",
}, "'index'")
_FILE_BODY = "CASE WHEN page_id % 3 = 0 THEN html ELSE " + _pick("page_id % 14", {
    0: f"'APP_KEY=1' || {_NL} || html", 1: f"html || {_NL} || 'create table t (a int)'",
    2: "'app_key=1'", 3: "'-----BEGIN' || ' X'", 4: "'<?php echo 1;'", 5: "'GET / 200'", 6: "'name: x'",
    7: _json('{"a": [1, 2]}'), 8: "'ref: refs/heads/main'", 9: "'Bud1'", 10: "'no marker'", 11: "'<x/>'", 12: "'<?= 1'",
}, "'plain'") + " END"

_LINKS = (
    "html || '<a href=\"' || " + _ORIGIN + " || '/p' || cast(page_id % 20 as string) || '\">a</a>'"
    " || '<a class=x href=\"/p' || cast((page_id + 1) % 20 as string) || '#frag\">b</a>'"
    " || '<a href=\"mailto:x@y.test\">c</a><a href=\"#top\">d</a><a href=\"javascript:go()\">e</a>'"
    " || '<img alt=\"\" src=\"https://off.scope.test/i.png\"><form method=post action=\"/send?x=' || cast(page_id as string) || '\">'"
    " || '<iframe src=\"//sub.' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/f\"></iframe>'"
    " || '<link rel=next href=\"./n' || cast(page_id as string) || '\"><div href=\"/ignored\">'"
)

# view -> (tables it reads, SQL)
_VIEWS = {
    "docs": (f"""
        SELECT doc_id, 'https://' || source || '.corpus.test' AS target, cast(doc_id as string) AS source_id,
               'https://' || source || '.corpus.test/doc/' || cast(doc_id as string) AS url, lang, source,
               text || {_NL} || {_SHAPE} || {_NL} || '  again ' || {_SHAPE} || {_NL} || {_DECOY} AS text
        FROM {{documents}}"""),
    "turns": (f"""
        SELECT conv_id, turn, 'https://chat.test' AS target, cast(conv_id as string) AS source_id,
               'https://chat.test/' || cast(conv_id as string) || '/' || cast(turn as string) AS url,
               text || {_NL} || {_CSHAPE} AS text
        FROM {{conversations}}"""),
    "context_docs": (f"""
        SELECT doc_id, 'https://' || source || '.corpus.test/doc/' || cast(doc_id as string) AS url,
               text || {_NL} || '   left ' || {_SHAPE} || ' right   ' || {_NL} ||
               CASE doc_id % 3
                 WHEN 0 THEN repeat('long ', 50) || {_SHAPE} || {_NL} || 'end'
                 WHEN 1 THEN 'one AK' || 'IA' || upper(substring(md5(cast(doc_id as string)), 1, 16)) || ' two AK' ||
                             'IA' || upper(substring(md5(cast(doc_id + 1 as string)), 1, 16)) || ' done' || {_NL}
                 ELSE 'last ' || {_SHAPE} || ' ' || repeat('tail ', 40) END AS text
        FROM {{documents}}"""),
    "hosts": (f"SELECT target, {_HEX} AS hx FROM (SELECT DISTINCT {_ORIGIN} AS target FROM {{pages}}) x"),
    "captures": (f"""
        SELECT page_id, {_ORIGIN} AS target, url, url AS final_url, false AS redirected, 'root' AS probe,
               cast(CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END as int) AS status_code,
               CASE WHEN page_id % 11 = 0 THEN 'image/png' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
               {_RAW_HEADERS} AS raw_headers, {_BODY} AS body, cast(@bytes({_BODY}) as bigint) AS body_bytes
        FROM {{pages}}"""),
    "file_captures": (f"""
        SELECT page_id, {_ORIGIN} AS target, {_ORIGIN} || '/d' || cast(page_id as string) || '/' || {_FILE_NAME} || CASE WHEN page_id % 5 = 0 THEN '?v=1' ELSE '' END AS url,
               {_FILE_NAME} AS name, 200 AS status_code,
               CASE WHEN page_id % 4 = 0 THEN 'text/html' WHEN page_id % 9 = 1 THEN 'application/json' ELSE 'text/plain' END AS content_type,
               {_FILE_BODY} AS body, cast(@bytes({_FILE_BODY}) as bigint) AS body_bytes
        FROM {{pages}}"""),
    "link_pages": (f"SELECT page_id, {_ORIGIN} AS target, url, {_LINKS} AS body FROM {{pages}}"),
    "word_captures": (f"""
        SELECT page_id, {_ORIGIN} AS target, {_ORIGIN} || '/' || CASE page_id % 11 WHEN 0 THEN 'admin' WHEN 1 THEN 'admin/'
                 WHEN 2 THEN 'de.tar.gz' WHEN 3 THEN 'api/v1.json' WHEN 4 THEN 'backup.zip' WHEN 5 THEN 'backup.zip/'
                 WHEN 6 THEN 'other.php' WHEN 7 THEN '.git/config' WHEN 8 THEN 'fr.php.bak' WHEN 9 THEN '' ELSE 'en.env' END AS url
        FROM {{pages}}"""),
    "redirects": (f"""
        SELECT page_id, {_ORIGIN} AS target, true AS redirected,
               {_ORIGIN} || '/go?' || CASE page_id % 6
                 WHEN 0 THEN 'a=1&next=https%3A%2F%2FOut.test%2Fx&url=y'
                 WHEN 1 THEN 'blank=&to=out.test&q=a+b'
                 WHEN 2 THEN 'id=5'
                 WHEN 3 THEN 'Redirect=/landing&x'
                 WHEN 4 THEN 'k=%zz&slash=/'
                 ELSE 'u=https://out.test/x&u=again' END AS url,
               CASE WHEN page_id % 7 = 0 THEN {_ORIGIN} || '/landing' WHEN page_id % 7 = 1 THEN 'https://other.test/landing'
                 ELSE 'https://out.test/x' END AS final_url
        FROM {{pages}}"""),
    "soft_pages": (f"""
        SELECT page_id, {_ORIGIN} AS target, url, 200 AS status_code, 'text/html' AS content_type,
               CASE page_id % 4 WHEN 0 THEN '<html><title>Oops 404</title><p>Nothing  here, code ' || cast(page_id as string) || '. token: "' || md5({_ORIGIN}) || '"</p></html>'
                 WHEN 1 THEN '<html><title>Oops 404</title><p>Nothing here, for page x' || cast(page_id % 9 as string) || 'y, code 7. token: "' || md5({_ORIGIN}) || '"</p></html>'
                 ELSE html || ' token: "' || {_PAGE_MD5} || '"' END AS body
        FROM {{pages}}"""),
    "baselines": (f"""
        SELECT DISTINCT {_ORIGIN} AS target, {_ORIGIN} || '/zqxj' AS url, 'baseline' AS probe, 200 AS status_code,
               '<html><title>Oops 404</title><p>Nothing here, code 31337. token: "' || md5({_ORIGIN}) || '"</p></html>' AS body
        FROM {{pages}}"""),
    "catch_all_pages": ("SELECT page_id, target, url || '/soft' AS url, status_code, content_type, body FROM soft_pages"),
    "page_captures": ("""
        SELECT page_id, target, url, status_code, content_type, body, body_bytes FROM captures
        UNION ALL SELECT page_id, target, url, status_code, content_type, body, body_bytes FROM file_captures
        UNION ALL SELECT page_id, target, url, status_code, content_type, body, cast(@bytes(body) as bigint) FROM catch_all_pages
        UNION ALL SELECT page_id, target, url, cast(NULL as int), cast(NULL as string), cast(NULL as string), cast(NULL as bigint) FROM redirects"""),
    "doc_pages": ("SELECT doc_id, lang AS target, cast(doc_id as string) AS url, 200 AS status_code, text AS body FROM {documents}"),
    "landed": (f"""
        SELECT target, CASE page_id % 6 WHEN 0 THEN chr(123) || '"target": "' || target || '", "url": "' || {_PAGE_MD5}
               WHEN 1 THEN chr(123) || '"target": "' || target || '", "url": "u", "status_code": "none"' || chr(125)
               WHEN 2 THEN chr(123) || '"target": "' || target || '", "body": "x"' || chr(125)
               WHEN 3 THEN chr(123) || '"target": "' || target || '", "url": "' || {_PAGE_MD5} || '", "status_code": 200, "unknown": [1]' || chr(125)
               ELSE chr(123) || '"target": "' || target || '", "url": "' || {_PAGE_MD5} || '", "status_code": 200, "content_type": "TEXT/html", "probe": "root", "body": "é' || cast(page_id as string) || '"' || chr(125) END AS line,
               page_id % 6 AS kind, length(cast(page_id as string)) + 2 AS size
        FROM captures"""),
    "cors_probes": (f"""
        SELECT target, target AS url, 'cors' AS probe, 'https://probe.invalid' AS request_origin, 200 AS status_code,
               CASE WHEN hx IN ('0', '1', '2') THEN 'Access-Control-Allow-Origin: *' || {_NL} || 'Access-Control-Allow-Credentials: True'
                    WHEN hx IN ('3', '4') THEN 'access-control-allow-origin: https://probe.invalid'
                    WHEN hx IN ('5', '6') THEN 'Access-Control-Allow-Origin: https://probe.invalid' || {_NL} || 'Access-Control-Allow-Credentials: true'
                    WHEN hx IN ('7', '8') THEN 'Access-Control-Allow-Origin: *' ELSE '' END AS raw_headers
        FROM hosts"""),
    "options_probes": (f"""
        SELECT target, target AS url, 'options' AS probe, 200 AS status_code,
               CASE WHEN hx IN ('0', '1', '2') THEN 'Allow: GET, put ,TRACE, DELETE'
                    WHEN hx IN ('3', '4') THEN 'Allow:' || {_NL} || 'Access-Control-Allow-Methods: GET,CONNECT'
                    WHEN hx IN ('5', '6') THEN 'Allow: GET, HEAD' ELSE '' END AS raw_headers
        FROM hosts"""),
    "endpoint_probes": (f"""
        SELECT target, target || '/.well-known/security.txt' AS url, 'securitytxt' AS probe, 404 AS status_code, 'gone' AS body FROM hosts
        UNION ALL SELECT target, target || '/security.txt', 'securitytxt', 200,
               CASE WHEN hx IN ('0', '1', '2', '3', '4', '5', '6') THEN 'Contact: x' ELSE '  ' || {_NL} END FROM hosts
        UNION ALL SELECT target, target || '/graphql', 'graphql', CASE WHEN hx < '5' THEN 200 ELSE 404 END,
               CASE WHEN hx < '3' THEN {_json('{"data": {"__schema": {}}}')} ELSE 'not json' END FROM hosts
        UNION ALL SELECT target, target || '/api/graphql', 'graphql', 200,
               CASE WHEN hx < '8' THEN {_json('{"data": {"__schema": {"queryType": {"name": "Q"}}}}')} ELSE {_json('{"data": null}')} END FROM hosts
        UNION ALL SELECT target, target || '/v1/graphql', 'graphql', 200, {_json('{"data": {"__schema": {"a": 1}}}')} FROM hosts"""),
    "tls": ("""
        SELECT target, regexp_extract(target, '^https?://([^/?#]+)', 1) AS host, 443 AS port,
               CASE WHEN hx IN ('0', '1') THEN 'TLSv1' WHEN hx = '2' THEN 'SSLv3' ELSE 'TLSv1.3' END AS protocol,
               CASE WHEN hx IN ('1', '3', '4') THEN 'Jun  1 12:00:00 2025 GMT' WHEN hx IN ('5', '6') THEN 'Jul 10 08:30:00 2025 GMT'
                    WHEN hx = '7' THEN 'not a date' ELSE 'Dec 31 23:59:59 2026 GMT' END AS not_after,
               CASE WHEN hx IN ('a', 'b') THEN 'certificate has expired' END AS verify_error
        FROM hosts WHERE target LIKE 'https:%'"""),
    "domains": ("SELECT domain, host, substring(md5(host), 1, 1) AS hx FROM (SELECT DISTINCT regexp_extract(target, '([a-z0-9-]+[.][a-z0-9-]+)$', 1) AS domain, regexp_extract(target, '^https?://([^/?#]+)', 1) AS host FROM hosts) x"),
    "ct": (f"""
        SELECT domain, '*.' || host || {_NL} || ' WWW.' || upper(host) || ' ' || {_NL} || domain || {_NL} || 'bad' || domain || {_NL} || 'else.test' AS name_value
        FROM domains"""),
    "dns": ("""
        SELECT domain, 'mail' || hx || '.' || domain AS host, hx <> 'f' AS resolves, false AS is_canary FROM domains
        UNION ALL SELECT domain, 'api.' || domain, true, false FROM domains
        UNION ALL SELECT domain, 'unlisted.' || domain, true, false FROM domains
        UNION ALL SELECT domain, 'zzqx.' || domain, domain LIKE '%.org', true FROM domains"""),
    "ports": (f"""
        SELECT host, 22 AS port, true AS open, false AS is_canary, {_NL} || '  SSH-2.0-Open_' || hx || '  ' || {_NL} || 'x' AS banner_raw FROM domains
        UNION ALL SELECT host, 80, true, false, 'HTTP/1.0 200 OK' || chr(13) || {_NL} || 'SERVER:  nginx/1.' || hx || chr(13) || {_NL} FROM domains
        UNION ALL SELECT host, 443, hx < '8', false, 'HTTP/1.0 200 OK' FROM domains
        UNION ALL SELECT host, 3306, hx > '3', false, '' FROM domains
        UNION ALL SELECT host, 8888, hx > '5', false, repeat('greeting ', 40) FROM domains
        UNION ALL SELECT host, 50001, hx IN ('c', 'd'), true, cast(NULL as string) FROM domains"""),
    "robots": (f"""
        SELECT target, target || '/robots.txt' AS url, CASE WHEN hx = '0' THEN 404 ELSE 200 END AS status_code,
               'User-agent: *' || {_NL} || 'Disallow: /admin' || hx || '/' || {_NL} || ' ALLOW : /no' || {_NL} || 'allow: /' || {_NL} || 'Allow:/pub' || hx ||
               {_NL} || 'Sitemap: ' || target || '/map.xml' || {_NL} || 'disallow:' AS body
        FROM hosts"""),
    "sitemaps": (f"""
        SELECT target, target || '/sitemap.xml' AS url, 200 AS status_code,
               '<urlset><url><LOC> ' || target || '/s' || hx || ' </LOC></url><loc>https://off.scope.test/x</loc>' || {_NL} ||
               '<loc>/relative</loc><loc>' || target || '/t</loc></urlset>' AS body
        FROM hosts"""),
    "recorded": (f"""
        SELECT page_id, {_ORIGIN} AS target, {_ORIGIN} || '/q' || cast(page_id as string) || '?page=1&ref=x' AS url,
               cast(page_id % 2 as int) AS param_index, CASE WHEN page_id % 2 = 0 THEN 'page' ELSE 'ref' END AS param,
               CASE WHEN page_id % 13 = 0 THEN '14' ELSE '1' END AS original, html FROM {{pages}}"""),
    "probe_results": (f"""
        SELECT target, url, url || '&t=x' AS test_url, param_index, param, original, 'xss' AS "check", 0 AS attempt,
               '<m' || cast(page_id as string) || '>' AS payload, 0 AS a, 0 AS b, 200 AS status_code,
               CASE page_id % 3 WHEN 0 THEN html || '<m' || cast(page_id as string) || '>' WHEN 1 THEN html || '&lt;m' || cast(page_id as string) || '&gt;' ELSE html END AS body,
               html AS baseline_body FROM recorded
        UNION ALL SELECT target, url, url || '&t=q', param_index, param, original, 'sqli', 0, original || '''', 0, 0, 500,
               html || CASE page_id % 5 WHEN 0 THEN 'You have an ERROR in your SQL syntax' WHEN 1 THEN 'ORA-01756: quoted string not properly terminated'
                 WHEN 2 THEN 'Warning: mysql_query()' ELSE '' END,
               html || CASE WHEN page_id % 7 = 0 THEN 'ora-12345' ELSE '' END FROM recorded
        UNION ALL SELECT target, url, url || '&t=f', param_index, param, original, 'traversal', 0, 'recorded', 0, 0, 200,
               CASE WHEN page_id % 3 = 1 THEN html ELSE 'root:x:0:0:root' END, html FROM recorded
        """ + "".join(f"""UNION ALL SELECT target, url, url || '&t=s{n}', param_index, param, original, 'ssti', {n}, 'recorded {n}', 14, 17, 200,
               CASE WHEN page_id % 5 = {n} THEN 'is 238 ok' WHEN page_id % 5 = 3 THEN 'is 12380' WHEN page_id % 5 = 4 THEN '(238)' ELSE html END,
               CASE WHEN page_id % 11 = 0 THEN 'was 238' WHEN page_id % 11 = 1 THEN 'was 2389' ELSE '' END
               FROM recorded
        """ for n in range(3))),
}

TABLES = ("documents", "conversations", "pages")
WORDS = ("admin", "backup.zip", "# comment", "", " de ", "en", "fr", ".git/config", "api/v1", "es/533")
LABELS = ("api", "mail0", "mail1", "mail2", "mail3", "mail4", "mail5", "www")


def _needs(name: str) -> list[str]:
    """The view and the planted views it is made of, in order of definition."""
    sql = _VIEWS[name]
    return [n for v in _VIEWS if v != name and re.search(rf"\b(FROM|,) {v}\b", sql) for n in _needs(v)] + [name]


def _ordered(names) -> list[str]:
    out = []
    for n in names:
        for d in _needs(n):
            if d not in out:
                out.append(d)
    return out


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the views for the comparison engine."""
    parts = []
    for v in _ordered(names):
        sql = _VIEWS[v].replace("@bytes", "strlen")
        for t in TABLES:
            sql = sql.replace("{%s}" % t, t)
        parts.append(f"{v} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n"


def view_of(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """The view over the given tables, which may be streams."""
    parts = []
    for v in _ordered([name]):
        sql = _VIEWS[v].replace("@bytes", "octet_length").replace('"check"', "`check`")
        parts.append(f"{v} AS ({sql})")
    sql = "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}"
    return spark.sql(sql, **{t: f for t, f in tables.items() if "{%s}" % t in sql})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables in ``sf_dir``."""
    return view_of(spark, name, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})
