"""Named queries of the driver contract with their SQL counterparts."""
