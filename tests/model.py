"""A one-by-one model of the ingest rules, for comparison with the set-level plans."""


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


class Library:
    """contents: id -> dict(sha, bits, group, dist, status); files: path -> dict(content, type)."""

    STORED = ("UPLOADED", "INDEXED", "INDEXING")

    def __init__(self):
        self.contents = {}
        self.files = {}
        self.by_sha = {}

    def add_content(self, sha, bits, status="INDEXED"):
        cid = max(self.contents, default=0) + 1
        self.contents[cid] = {"sha": sha, "bits": bits, "group": None, "dist": None, "status": status}
        self.by_sha[sha] = cid
        return cid

    def nearest(self, bits, threshold):
        first, last = {}, {}
        for cid in sorted(self.contents):
            content = self.contents[cid]
            if content["status"] in self.STORED:
                first.setdefault(content["bits"], cid)
                last[content["bits"]] = cid
        best = None
        for other, seen in first.items():
            d = distance(bits, other)
            if d <= threshold and (best is None or (d, seen) < best[:2]):
                best = (d, seen, last[other])
        return best and (best[0], best[2])

    def ingest(self, path, sha, bits, policy, threshold=5):
        cid = self.by_sha.get(sha)
        if cid is not None and self.contents[cid]["status"] in self.STORED:
            held = any(f["content"] == cid for f in self.files.values())
            kind = "DUPLICATE" if held else "ORIGINAL"
        elif cid is not None:
            self.contents[cid]["status"], kind = "UPLOADED", "ORIGINAL"
        else:
            near = self.nearest(bits, threshold)
            if near and policy == "discard":
                cid, kind = near[1], "SIMILAR"
            else:
                cid, kind = self.add_content(sha, bits, "UPLOADED"), "ORIGINAL"
                if near:
                    match = self.contents[near[1]]
                    if match["group"] is None:
                        match["group"] = near[1]
                    self.contents[cid]["group"], self.contents[cid]["dist"] = match["group"], near[0]
        row = self.files.get(path)
        if row is None:
            self.files[path] = {"content": cid, "type": kind}
        elif row["content"] != cid:
            row.update(content=cid, type=kind)

    def batch(self, files, policy, threshold=5):
        """files: (path, sha, bits). Files that resume an interrupted store come first."""
        waiting, order = set(), []
        for path, sha, bits in sorted(files):
            cid = self.by_sha.get(sha)
            resumes = cid is not None and self.contents[cid]["status"] not in self.STORED and sha not in waiting
            waiting.add(sha) if resumes else None
            order.append((0 if resumes else 1, path, sha, bits))
        for _, path, sha, bits in sorted(order):
            self.ingest(path, sha, bits, policy, threshold)
