"""DataFrame operators: encoding, class counts, sampling, neighbours, links."""
