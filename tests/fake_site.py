"""A site for tests of live fetching: host bad throws, host two has robots.txt, others have three pages, the last of them empty."""

import json

from shelfwatch.sources.fetch import Response


def transport(settings):
    def get(url, headers):
        if url.endswith("robots.txt"):
            return Response(200, "User-agent: *\nDisallow: /private") if "two" in url else Response(404)
        if "bad" in url:
            raise LookupError("unknown encoding: x")
        n = int(url.partition("page=")[2] or 1)
        return Response(200, json.dumps({"products": [{"handle": f"p{n}"}] if n < 3 else []}), {"content-type": "application/json"})

    return get
