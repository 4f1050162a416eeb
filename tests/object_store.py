"""An object store in memory that speaks as much of S3's protocol as writing and reading files takes; for tests."""

import io
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit
from xml.etree import ElementTree
from xml.sax.saxutils import escape

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
TIME = "Wed, 01 Jan 2025 00:00:00 GMT"


class Store(ThreadingHTTPServer):
    """Objects of all buckets, by ``bucket/key``; ``moves`` counts copies of objects."""

    daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.objects, self.uploads, self.moves = {}, {}, 0
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def environment(self) -> dict[str, str]:
        return {"AWS_ENDPOINT_URL": f"http://127.0.0.1:{self.server_port}", "AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s", "AWS_DEFAULT_REGION": "us-east-1", "AWS_EC2_METADATA_DISABLED": "true"}


def unchunked(file) -> bytes:
    """What lies in chunks, up to and with the lines behind the last one."""
    out = b""
    while n := int(file.readline().partition(b";")[0], 16):
        out += file.read(n)
        file.readline()
    while file.readline().strip():
        pass
    return out


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *told):
        pass

    def reply(self, status: int, body: bytes = b"", **headers):
        self.send_response(status)
        for name, value in ({"Content-Length": len(body), "Last-Modified": TIME, "ETag": '"e"'} | headers).items():
            self.send_header(name.replace("_", "-"), str(value))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def missing(self):
        self.reply(404, f"{HEAD}<Error><Code>NoSuchKey</Code><Message>none</Message></Error>".encode())

    def asked(self):
        url = urlsplit(self.path)
        return unquote(url.path).strip("/") if not unquote(url.path).endswith("/") else unquote(url.path).lstrip("/"), {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}

    def body(self) -> bytes:
        if self.headers.get("Transfer-Encoding", "") == "chunked":
            data = unchunked(self.rfile)
        else:
            data = self.rfile.read(int(self.headers.get("Content-Length", 0)))
        return unchunked(io.BytesIO(data)) if "aws-chunked" in self.headers.get("Content-Encoding", "") else data

    def do_PUT(self):
        key, query = self.asked()
        if source := self.headers.get("x-amz-copy-source"):
            self.server.moves += 1
            self.server.objects[key] = self.server.objects[unquote(source).lstrip("/")]
            self.reply(200, f"{HEAD}<CopyObjectResult><ETag>e</ETag></CopyObjectResult>".encode())
        elif "uploadId" in query:
            self.server.uploads[query["uploadId"]][int(query["partNumber"])] = self.body()
            self.reply(200)
        else:
            self.server.objects[key] = self.body()
            self.reply(200)

    def do_POST(self):
        key, query = self.asked()
        data = self.body()
        if "uploads" in query:
            upload = f"u{len(self.server.uploads)}"
            self.server.uploads[upload] = {}
            self.reply(200, f"{HEAD}<InitiateMultipartUploadResult><UploadId>{upload}</UploadId></InitiateMultipartUploadResult>".encode())
        elif "uploadId" in query:
            parts = self.server.uploads[query["uploadId"]]
            self.server.objects[key] = b"".join(parts[n] for n in sorted(parts))
            self.reply(200, f"{HEAD}<CompleteMultipartUploadResult><ETag>e</ETag></CompleteMultipartUploadResult>".encode())
        else:
            for e in ElementTree.fromstring(data).iter():
                if e.tag.endswith("Key"):
                    self.server.objects.pop(f"{key.strip('/')}/{e.text}", None)
            self.reply(200, f"{HEAD}<DeleteResult></DeleteResult>".encode())

    def do_DELETE(self):
        self.server.objects.pop(self.asked()[0], None)
        self.reply(204)

    def do_HEAD(self):
        key, _ = self.asked()
        if "/" not in key.strip("/"):
            return self.reply(200)
        data = self.server.objects.get(key)
        return self.missing() if data is None else self.reply(200, data)

    def do_GET(self):
        key, query = self.asked()
        if "list-type" in query:
            return self.listed(key.strip("/"), query.get("prefix", ""), query.get("delimiter", ""))
        data = self.server.objects.get(key)
        if data is None:
            return self.missing()
        if part := self.headers.get("Range"):
            first, _, last = part.removeprefix("bytes=").partition("-")
            piece = data[int(first) : int(last) + 1 if last else None]
            return self.reply(206, piece, Content_Range=f"bytes {first}-{int(first) + len(piece) - 1}/{len(data)}")
        self.reply(200, data)

    def listed(self, bucket: str, prefix: str, delimiter: str):
        keys, folders = [], set()
        for at in sorted(self.server.objects):
            own, _, key = at.partition("/")
            if own != bucket or not key.startswith(prefix):
                continue
            below, cut, _ = key[len(prefix) :].partition(delimiter) if delimiter else (key, "", "")
            if cut:
                folders.add(prefix + below + cut)
            else:
                keys.append(f"<Contents><Key>{escape(key)}</Key><LastModified>2025-01-01T00:00:00.000Z</LastModified><Size>{len(self.server.objects[at])}</Size></Contents>")
        both = keys + [f"<CommonPrefixes><Prefix>{escape(f)}</Prefix></CommonPrefixes>" for f in sorted(folders)]
        self.reply(200, f"{HEAD}<ListBucketResult><KeyCount>{len(both)}</KeyCount><IsTruncated>false</IsTruncated>{''.join(both)}</ListBucketResult>".encode())
