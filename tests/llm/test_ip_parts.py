"""Parts of IP addresses with leading zeros."""

from graphloom.llm import pii


def test_leading_zeros_do_not_hide_a_large_part():
    ips = lambda text: [text[s:e] for s, e, kind in pii.base_spans(text) if kind == "ip"]
    for bad in ("00256.1.1.1", "1.000300.1.1", "1.1.00999.1", "1.1.1.0001000", "256.1.1.1"):
        assert ips(f"at {bad} now") == []
    for good in ("00255.1.1.1", "0000.0.00.1", "000001.2.3.4", "10.020.030.255"):
        assert ips(f"at {good} now") == [good]
