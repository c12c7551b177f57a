"""Training-data operators: cleaning, tokenizing, packing, sharding, storage and de-duplication.

Nothing outside this folder imports it.  The modules ``m_*`` hold one operator each with its own general
interface; ``queries`` derives the registered ``opN_*`` queries from them.
"""
