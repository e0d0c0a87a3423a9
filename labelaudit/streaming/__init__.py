"""Row-wise operators on a stream of items.

Anchors and views are plain column expressions without state, so they run on a
stream as they are; nothing here keeps state or needs a watermark."""
