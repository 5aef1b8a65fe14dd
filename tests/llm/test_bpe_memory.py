"""What a worker that encodes keeps."""

from provena.llm import bpe
from provena.llm.queries import vocabulary


def test_codec_forgets_pieces_and_ranks_by_itself_only_when_asked():
    path, pattern = vocabulary()
    with open(path, "rb") as f:
        own = bpe.Codec(f.read(), pattern)
    assert own.ranked is None
    some = [" ".join(f"w{k}x{i}" for i in range(1500)) for k in range(60)]
    own.encode(some[:1])
    most = 0
    for t in some:
        before = own.encode([t])
        most = max(most, len(own.ids))
    assert most <= 70_000
    assert bytes(own.decode(bpe.np.frombuffer(before[0], "<u4").astype("int64"))).decode() == some[-1]
    assert own.by_rank("banana banana") and own.ranked is not None
