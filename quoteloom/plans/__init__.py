"""The registered queries and their SQL."""

from quoteloom.plans import authority, bundles, evidence, market, payloads, published, records, responses, support, vendors

PLANS = (market, evidence, authority, records, vendors, support, bundles, responses, payloads, published)
