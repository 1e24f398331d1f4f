"""Row types of the library in DDL, and the texts that stand for missing values in reports."""

from __future__ import annotations

#: Site texts that callers may replace: what stands for an unknown stock state, an unknown seller, the fast channel.
UNKNOWN_STOCK, DEFAULT_SELLER, FAST_CHANNEL, STANDARD_CHANNEL = "Check on site", "Marketplace", "Express", "Standard"

OFFER_FIELDS = "product_name string, mrp double, price double, discount_percent string, city string, in_stock string, delivery_date string, free_delivery string, seller string, rating string, reviews string, bsr string, product_url string, scraped_at string, status string, failure_reason string"
OFFERS = "asin string, pincode string, " + OFFER_FIELDS
#: What an absent key of a stored offer means; a key that is there with null stays null.
OFFER_DEFAULTS = {"product_name": "", "discount_percent": "N/A", "city": "", "in_stock": "", "delivery_date": "", "free_delivery": "", "seller": "", "rating": "", "reviews": "", "bsr": "N/A", "product_url": "", "scraped_at": "", "status": "FAILED", "failure_reason": ""}
