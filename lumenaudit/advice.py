"""Advice texts attached to findings."""

from __future__ import annotations

REMEDIATION = {
    "api_keys": "Treat the key as leaked: revoke it, issue a new one and keep it in a secret store.",
    "passwords": "Change this password now and keep credentials out of published content.",
    "database": "Change the database credentials, restrict who can connect and keep the address out of published content.",
    "financial": "Revoke the payment credential with the provider and issue a new one.",
    "tokens": "Invalidate the token, issue a new one and keep it in a secret store.",
    "private_keys": "The key is compromised: replace it and every certificate that uses it.",
    "exposed_sensitive_file": "Stop serving this file and rotate whatever it contains.",
    "config_files": "Keep configuration files outside the served directory.",
    "internal_ips": "Remove internal addresses from published output.",
    "sensitive_file_reference": "Check that the referenced file cannot be fetched and drop the reference.",
    "emails": "Decide whether this address has to be public.",
    "directory_listing": "Turn off directory indexes on the web server.",
    "open_redirect": "Accept only known redirect destinations.",
    "xss_reflected": "Escape user input for the context it is written into.",
    "sqli_error": "Use parameterised statements and hide database errors from users.",
    "path_traversal": "Resolve requested files against a fixed list.",
    "ssti": "Pass user input to templates as data, never as template source.",
    "ssrf_candidate": "Check destinations against an allow list before the server fetches them.",
}

HEADER_ADVICE = {
    "strict-transport-security": "Browsers may be downgraded to plain HTTP without HSTS.",
    "content-security-policy": "Without a content policy injected script runs unhindered.",
    "x-frame-options": "The page can be framed by another site; deny framing here or in the content policy.",
    "x-content-type-options": "Browsers may guess the content type; ask them not to.",
    "referrer-policy": "Full addresses may leak to other sites through the referrer.",
    "permissions-policy": "Browser features such as camera and location are not restricted.",
}
NOSNIFF = 'The only meaningful value is "nosniff".'
BANNER = "Version banners help to look up known weaknesses; consider hiding them."
COOKIE = "A cookie without these flags can be read or sent in situations it should not be."
CORS_WILDCARD = "A wildcard origin together with credentials is a contradictory and unsafe policy."
CORS_REFLECTED = "Any site can read responses when the server echoes the origin it was sent."
TLS_PROTOCOL = "Allow TLS 1.2 and later only."
MIXED = "A resource fetched over plain HTTP can be altered on the way; use HTTPS."
SRI = "Pin the resource with an integrity attribute so that a changed file is refused."
SECURITY_TXT = "Publish a security.txt (RFC 9116) so that problems can be reported."
GRAPHQL = "Switch introspection off in production."
TECH = "Look up known weaknesses of"
GENERATOR = "Generator tags name the software and often its version."
WAF = "A protection layer sits in front; later observations may be filtered."
SUBDOMAIN = "Confirm that this host is meant to be public."
PORT = "Confirm that this service is meant to be reachable."
PORT_CVE = "Look up known weaknesses of this banner:"
CANARY = "Repeat the port observations from a network that does not intercept connections."
SSRF = "Name-based hint only; verify by hand within an authorised test."
