"""Keyword lists by name, and the lists as a table.  Fixed values."""

from pyspark.sql import DataFrame, SparkSession

CUDA = """
__global__ __device__ __host__ blockIdx blockIdx.x blockIdx.y blockIdx.z threadIdx threadIdx.x threadIdx.y
threadIdx.z blockDim blockDim.x blockDim.y blockDim.z gridDim gridDim.x gridDim.y gridDim.z __syncthreads()
__shared__ atomicAdd atomicSub atomicExch __ballot() __shfl() __shfl_up() __shfl_down() __shfl_xor() texture
tex1Dfetch tex2D __ldg
""".split()

CUDA_STRICT = ["threadIdx", "blockIdx", "blockDim"]

CPP = """
alignas alignof and and_eq asm atomic_cancel atomic_commit atomic_noexcept auto bitand bitor bool break case
catch char char8_t char16_t char32_t class compl concept const consteval constexpr const_cast continue co_await
co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float
for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private
protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast
struct switch synchronized template this thread_local throw true try typedef typeid typename union unsigned
using virtual void volatile wchar_t while xor xor_eq
""".split()

CPP_AVOID = """
virtual goto try catch throw typeid reinterpret_cast dynamic_cast static_cast const_cast new delete namespace
template friend explicit using asm
""".split()

_FORTRAN = """
accept allocatable allocate assign associate backspace block blockdata byte call case character close common
complex contains continue cycle data deallocate default dimension do double doubleprecision dowhile elemental
else elseif elsewhere end endblock endblockdata endfile endif endinterface endmodule endprogram endselect
endsubmodule endsubroutine endtype endwhere entry enum equivalence exit external file format function generic
go goto if implicit import in include inout intent interface intrinsic is kind len lentrim logical module name
none null nullify only open operator optional out parameter pass pause pointer precision print private
procedure program public pure real read recursive result return rewind save select sequence stop submodule
subroutine target then to type use value volatile where while write
""".split()

KEYWORDS = {
    "cuda_keywords": CUDA,
    "cuda_keywords_strict": CUDA_STRICT,
    "cpp_keywords": CPP,
    "cpp_avoid": CPP_AVOID,
    "fortran_keywords": [w.upper() for w in _FORTRAN] + _FORTRAN,
}


def keyword_table(spark: SparkSession, lists=None) -> DataFrame:
    """(list_name, keyword) rows."""
    lists = lists or KEYWORDS
    return spark.createDataFrame(
        [(name, k) for name, ks in lists.items() for k in ks], "list_name string, keyword string"
    )
