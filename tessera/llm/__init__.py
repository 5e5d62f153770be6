"""Operations of a training-data pipeline over ``documents``, ``pages``,
``labels``, ``benchmark`` and ``conversations``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it."""
