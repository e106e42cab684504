"""Log lines for the tests."""


def line(ip="1.2.3.4", path="/", status=200, agent="Mozilla/5.0", second=0, referrer="-", method="GET"):
    stamp = f"15/Jan/2024:{10 + second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d} +0000"
    return f'{ip} - - [{stamp}] "{method} {path} HTTP/1.1" {status} 512 "{referrer}" "{agent}"'
