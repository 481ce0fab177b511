"""Named queries over the driver's tables; importing registers them."""
