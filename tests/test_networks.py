"""Addresses and networks against the standard library's own."""

import ipaddress
import random

from webloom.operators import networks

ODD = [None, "", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "g::1", "12345::", "::ffff:1.2.3.4", "::1.2.3.256", "1.2.3.4::", "fe80::1%eth0", "[::1]", "ABCD::Ef", "a.b.c.d", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1..2.3"]


def parsed(text):
    try:
        ip = ipaddress.ip_address(text.strip().lstrip("[").rstrip("]").split("%")[0])
    except (ValueError, AttributeError):
        return None
    return ip if ip.version == 6 else ipaddress.IPv6Address(f"::ffff:{ip}")


def some(r):
    return str(ipaddress.IPv4Address(r.getrandbits(32) & 0x0F0F00FF)) if r.random() < 0.5 else str(ipaddress.IPv6Address(r.choice([0x20010DB8 << 96, 1 << 120]) | r.getrandbits(128) & (0xFF00FF << 60 | 0xF0F)))


def test_address_hex(spark):
    r = random.Random(1)
    given = ODD + [some(r) for _ in range(300)] + [ipaddress.IPv6Address(r.getrandbits(128)).exploded for _ in range(50)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, a string")
    got = {x.i: x.h for x in got.select("i", networks.address_hex(got["a"]).alias("h")).collect()}
    for i, text in enumerate(given):
        ip = parsed(text)
        assert got[i] == (None if ip is None else f"{int(ip):032x}"), text


def test_networks(spark):
    r = random.Random(2)
    nets = []
    for k in range(250):
        base = some(r)
        nets.append((f"{base}/{r.randint(0, 128 if ':' in base else 32)}", f"n{k:03d}"))
    nets += [("10.0.0.0/33", "bad"), ("x/8", "bad"), (None, "bad"), ("1.2.3.4/8/9", "bad"), ("::/129", "bad"), ("1.2.3.4/", "bad"), ("5.6.7.8", "one"), ("0.0.0.0/0", "all4"), ("0.0.0.0/0", "ball4")]
    given = ODD + [some(r) for _ in range(300)] + ["5.6.7.8", "5.6.7.8"]
    held = []
    for cidr, name in nets:
        if name != "bad":
            n = ipaddress.ip_network(cidr, strict=False)
            held.append((n.prefixlen + (96 if n.version == 4 else 0), int(parsed(str(n.network_address))), name))
    table = spark.createDataFrame(nets, "cidr string, name string")
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, address string").repartition(3)
    all_of = {x.i: x.networks for x in networks.matches(asked, table).collect()}
    least = {x.i: x.network for x in networks.narrowest(asked, table).collect()}
    assert len(all_of) == len(least) == len(given)
    for i, text in enumerate(given):
        ip = parsed(text)
        want = [] if ip is None else sorted(((b, n) for b, low, n in held if int(ip) >> (128 - b) == low >> (128 - b)), reverse=True)
        assert [tuple(x) for x in all_of[i] or ()] == want, text
        assert least[i] == (min((-b, n) for b, n in want)[1] if want else None), text
    assert networks.narrowest(asked, table.limit(0)).filter("network IS NOT NULL").count() == 0
    assert networks.matches(asked, table.limit(0)).filter("networks IS NOT NULL").count() == 0
