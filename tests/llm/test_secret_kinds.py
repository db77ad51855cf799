"""Secrets that are short, hold no digit or any symbol, and headers of private keys."""

from graphloom.llm import secrets

WANTED = {
    'login password: "hunter2pass"\n': "hunter2pass",
    'secret = "correcthorsebatterystaple"\n': "correcthorsebatterystaple",
    'pwd: "Tr0ub4dor&3xyz!" and more': "Tr0ub4dor&3xyz!",
    "é passwd = 'open!sesame' and more": "open!sesame",
    "x\n-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQEA": "-----BEGIN RSA PRIVATE KEY-----",
    "x\n-----BEGIN PRIVATE KEY-----\nMIIEowIBAAKCAQEA": "-----BEGIN PRIVATE KEY-----",
    "set DB_PASSWORD=hunter!xyz2 now": "DB_PASSWORD=hunter!xyz2",
}
HARMLESS = ["author: Mary wrote this", "token = null\n", 'password: "<your-password>"\n', "password: required\n", "token: the sign that stands for a word", "-----BEGIN CERTIFICATE-----\nabc"]


def test_kinds_without_length_or_digits(spark):
    rows = [(k, t) for k, t in enumerate([*WANTED, *HARMLESS])]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(rows[r.doc_id][1][r.start : r.end] == r.secret for r in got)
    assert {(r.doc_id, r.secret) for r in got} == set(enumerate(WANTED.values()))
